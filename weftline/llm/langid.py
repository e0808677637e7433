"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, runs of everything else are one blank, and n-grams of 2 and 3
characters hash to ``buckets``. The model is fitted on a bounded sample of labelled
rows, ``per_language`` rows of each language in the order of a hash of their id and
text (all, if fewer); its counts are summed on the executors, and the log-probability
matrix (buckets x languages, float32) is broadcast. A batch of texts is scored at once:
only the buckets that occur are gathered and summed by text.

LANGUAGES languages make one matrix (64 of them and 65,536 buckets: 17 MB). Where there
are more, the next ones make further matrices, and texts are scored against one after the
other, each pass keeping the best language so far and the mass of all; every language is
weighed as if there were one matrix. Texts are read in pieces of PIECE characters, and n-grams
across two pieces are counted, so a text of any length needs the memory of a piece. Weights
are multiples of 2**-20, so sums are exact and neither pieces nor batches change a score.

score is the posterior of the predicted language under equal priors, with the
log-likelihood scaled to at most ``evidence`` n-grams, for n-grams overlap and a long
text is not so many independent observations. A text that is null or without a letter
is ``und`` with score 0, as is any text where nothing could be learned. Of equal
languages the first by name is predicted. Rows are judged one by one: null or repeated
ids change nothing, columns named like an added one are replaced, others are carried,
and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.workers import trimmed

PER_LANGUAGE = 2000
BUCKETS = 1 << 16
ORDERS = (2, 3)
EVIDENCE = 200.0
SMOOTHING = 0.5
#: Languages of a matrix.
LANGUAGES = 64
UNKNOWN = "und"
ADDED = ("held_out", "lang_pred", "score")
#: Characters of a text that are read at once, characters that are scored at once, and weights that are gathered at once.
PIECE, BLOCK, CELLS = 100_000, 200_000, 1_000_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _normal(text: str, last: int = 32) -> np.ndarray:
    """Code points with one blank between runs of letters, and one before them unless what came ``last`` is one."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    if len(codes) and blank[0] and last != 32:
        keep[0] = True
    return codes[keep].astype(np.uint64)


def pieces(text: str | None) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, how many of these at the front were in the piece before) of a text, with a blank at both ends; none without a letter."""
    carry, begun, text = np.array([32], np.uint64), False, text or ""
    for i in range(0, len(text), PIECE):
        new = _normal(text[i : i + PIECE], int(carry[-1]))
        last = i + PIECE >= len(text)
        if last and (begun or len(new)) and (new[-1] if len(new) else carry[-1]) != 32:
            new = np.append(new, np.uint64(32))
        if len(new):
            yield np.concatenate([carry, new]), len(carry) if begun else 0
            begun, carry = True, np.concatenate([carry, new])[1 - max(ORDERS) :]


def _grams(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character, a row for each order; -1 where it would pass the end."""
    out = np.full((len(ORDERS), len(codes)), -1, np.int64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for row, n in enumerate(ORDERS):
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * _MIX[k % 3]
                h ^= h >> np.uint64(29)
            out[row, : len(h)] = ((h * _MIX[0]) >> shift).astype(np.int64)
    return out


def _counted(grams: np.ndarray, n: int, old: int) -> np.ndarray:
    """Where a piece's n-grams of an order stand that are neither past its end nor counted with the piece before."""
    inside = grams >= 0
    inside[: max(old - n + 1, 0)] = False
    return inside


def _text_grams(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of all n-grams of a text and how often each occurs, a row for each."""
    found = np.zeros((0, 2), np.int64)
    for codes, old in pieces(text):
        grams = _grams(codes, buckets)
        new = np.concatenate([g[_counted(g, n, old)] for g, n in zip(grams, ORDERS, strict=True)])
        new = np.stack(np.unique(new, return_counts=True), axis=1)
        at, where = np.unique(np.concatenate([found[:, 0], new[:, 0]]), return_inverse=True)
        found = np.stack([at, np.bincount(where, np.concatenate([found[:, 1], new[:, 1]]), len(at)).astype(np.int64)], axis=1)
    return found


@dataclass
class Model:
    languages: list[str]
    #: log-probabilities, buckets x languages
    weights: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weights)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> list[Model]:
    """Models, one for each LANGUAGES languages by name, of the rows of ``df`` with a language; ``key`` orders the sample."""
    key = F.xxhash64(F.col(text)) if key is None else key
    known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(F.col(lang).alias("lang")).count().collect()}
    hashed = known.select(F.col(text).alias("text"), F.col(lang).alias("lang"), key.alias("key"))
    names = sorted(totals)
    return [_fit({k: totals[k] for k in names[i : i + LANGUAGES]}, hashed, per_language, buckets) for i in range(0, len(names), LANGUAGES)]


def _fit(totals: dict[str, int], hashed: DataFrame, per_language: int, buckets: int) -> Model:
    languages = list(totals)
    # A cut of the hash takes a few rows more than wanted, so that ranking sees a bounded number of rows of any language.
    cuts = {k: min(1.0, 1.5 * per_language / n + 200 / n) for k, n in totals.items()}
    part = F.create_map(*(x for k, v in cuts.items() for x in (F.lit(k), F.lit(v))))[F.col("lang")]
    near = hashed.filter(F.pmod("key", F.lit(1 << 40)) < F.lit(float(1 << 40)) * part)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 40)), "key"))
    sample = near.withColumn("rank", rank).filter(F.col("rank") <= per_language).repartition("rank").select("lang", "text")
    at = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(languages) * buckets, np.int64)
        for b in batches:
            for k, t in zip(b.column("lang"), b.column("text"), strict=True):
                grams = _text_grams(t.as_py(), buckets)
                sums[grams[:, 0] + at[k.as_py()] * buckets] += grams[:, 1]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["cell", "n"])

    cells = sample.mapInArrow(trimmed(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(len(languages) * buckets)
    sums[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    sums = sums.reshape(len(languages), buckets) + SMOOTHING
    weights = np.round(np.log(sums / sums.sum(axis=1, keepdims=True)) * 2**20) / 2**20
    return Model(languages, np.ascontiguousarray(weights.T.astype(np.float32)))


def likelihoods(model: Model, texts: Iterable[str | None], evidence: float = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) scaled log-likelihoods, and which texts have a letter."""
    texts = list(texts)
    total, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    step = max(1, CELLS // max(1, len(model.languages)))

    def flush(held: list[tuple[int, np.ndarray, int]]) -> None:
        sizes = np.array([len(codes) for _, codes, _ in held])
        ends = np.cumsum(sizes)
        owner = np.repeat([r for r, _, _ in held], sizes)
        grams = _grams(np.concatenate([codes for _, codes, _ in held]), model.buckets)
        for row, n in enumerate(ORDERS):
            for back in range(1, n):
                grams[row, ends - back] = -1
            for start, (_, _, old) in zip(ends - sizes, held, strict=True):
                grams[row, start : start + max(old - n + 1, 0)] = -1
            at = np.flatnonzero(grams[row] >= 0)
            counts[:] += np.bincount(owner[at], minlength=len(texts))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                own = owner[part]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                total[own[first]] += np.add.reduceat(model.weights[grams[row, part]].astype(np.float64), first, axis=0)

    held, size = [], 0
    for r, t in enumerate(texts):
        for codes, old in pieces(t):
            held.append((r, codes, old))
            size += len(codes)
            if size > BLOCK:
                flush(held)
                held, size = [], 0
    if held:
        flush(held)
    return total * np.minimum(1.0, evidence / np.maximum(counts, 1))[:, None], counts > 0


def score(models: Sequence[Model], texts: Iterable[str | None], evidence: float = EVIDENCE) -> tuple[list[str], list[float]]:
    """Predicted language and score of each text."""
    texts = list(texts)
    best = _nothing(len(texts))
    for model in models:
        best = _better(model, texts, *best, evidence)
    return _told(*best)


def _nothing(n: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """No language yet: names, their log-likelihoods, and the likelihoods of all so far as parts of the best."""
    return [UNKNOWN] * n, np.full(n, -np.inf), np.zeros(n)


def _better(model: Model, texts: list[str | None], langs: list[str], top: np.ndarray, mass: np.ndarray, evidence: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    total, lettered = likelihoods(model, texts, evidence)
    high = total.max(axis=1)
    own = np.exp(total - high[:, None])
    first = np.round(own, 9).argmax(axis=1)
    new = lettered & (np.round(np.exp(np.minimum(high - top, 700.0)), 9) > 1)
    most = np.where(lettered, np.maximum(high, top), 0.0)
    mass = np.where(lettered, mass * np.exp(np.where(mass > 0, top - most, 0.0)) + own.sum(axis=1) * np.exp(high - most), 0.0)
    langs = [model.languages[i] if is_new else old for i, is_new, old in zip(first, new, langs, strict=True)]
    return langs, np.where(lettered, most, top), mass


def _told(langs: list[str], top: np.ndarray, mass: np.ndarray) -> tuple[list[str], list[float]]:
    return langs, [round(float(1 / m), 6) if m > 0 else 0.0 for m in mass]


def predict(df: DataFrame, models: Sequence[Model], text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score; columns of these names are replaced. A pass over the texts for each model."""
    rest = [f for f in df.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in rest]
    held = "_weftline_lang struct<lang:string,top:double,mass:double>"
    between = T.StructType([*rest, *T._parse_datatype_string(held).fields])
    final = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if not models:
        return df.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    df = df.select(names)
    for i, model in enumerate(models):
        shared, ends = df.sparkSession.sparkContext.broadcast(model), i == len(models) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, begun=i > 0, ends=ends) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(text).to_pylist()
                best = _nothing(len(texts))
                if begun:
                    langs, top, mass = b.column(between.names[-1]).flatten()
                    best = langs.to_pylist(), top.to_numpy(), mass.to_numpy()
                langs, top, mass = _better(shared.value, texts, *best, EVIDENCE)
                kept = [b.column(c) for c in names]
                if ends:
                    langs, scores = _told(langs, top, mass)
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
                else:
                    state = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(top), pa.array(mass)], names=["lang", "top", "mass"])
                    yield pa.RecordBatch.from_arrays([*kept, state], names=[*names, between.names[-1]])

        df = df.mapInArrow(trimmed(run), final if ends else between)
    return df


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[Model]]:
    """``df`` with held_out, lang_pred and score, learned from the rows of ``df`` that are not held out."""
    models = fit(df.filter(~held_out(doc_id)), text, lang, F.xxhash64(F.col(doc_id), F.col(text)))
    return predict(df.withColumn("held_out", held_out(doc_id)), models, text), models
