"""Exact vector search, hybrid scores, assignment, and the health of an index."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.exprs import clamp, cosine
from weftline.operators.order import first_rows
from weftline.staging import stage

#: (steps from the source, boost).
GRAPH_BOOST = ((1, 0.2), (2, 0.1))
#: An index is rebuilt under this freshness or coverage, or over this part of stale rows.
FRESH, COVERED, STALE = 0.85, 0.70, 0.15
#: Rows of queries or sections that are broadcast at once.
BLOCK = 2048
#: Queries or sections that a task measures at once.
STRIP = 256
#: Vectors by whose angles others are told apart, and what rounding may add to an angle.
PIVOTS, SLACK = 64, 1e-6


def similarity(vectors: DataFrame, query: list[float], digits: int | None = None) -> DataFrame:
    score = cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query)).cast("array<float>"))
    return vectors.withColumn("score", F.round(score, digits) if digits is not None else score)


def top_k(vectors: DataFrame, query: list[float], k: int, digits: int | None = None) -> DataFrame:
    """The k rows of highest cosine, ties to the smaller id: a bounded heap in each task."""
    return similarity(vectors, query, digits).orderBy(F.desc("score"), F.asc("id")).limit(k)


def blocks(df: DataFrame, key: str, most: int | None = None) -> list[DataFrame]:
    """``df`` in parts of at most ``most`` rows (BLOCK, if not given), by a hash of its key; counted, so that each may be broadcast."""
    most, n = most or BLOCK, df.count()
    if n <= most:
        return [df]
    parts = -(-2 * n // most)
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    counts = {r["part"]: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}
    for p, rows in counts.items():
        if rows > most:
            raise ValueError(f"part {p} has {rows} rows of {key}, which repeats or is null; at most {most} are broadcast")
    return [df.filter(part == p) for p in sorted(counts)]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's round: half up, of the shortest decimal form."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled + 0.5)
    for at in np.argwhere(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-7):
        i = tuple(at)
        whole[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(whole / 10.0**digits, x) + 0.0


def _strips(vectors: Sequence[Sequence[float] | None]) -> list[tuple[int, int, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """(first, number, by length: places and vectors) of every STRIP vectors; those that are null, empty or hold nulls stand in no length."""
    out = []
    for first in range(0, len(vectors), STRIP):
        part = vectors[first : first + STRIP]
        by: dict[int, list[int]] = {}
        for i, v in enumerate(part):
            if v is not None and len(v) and None not in v:
                by.setdefault(len(v), []).append(i)
        out.append((first, len(part), {d: (np.array(at), np.array([part[i] for i in at], dtype=float)) for d, at in by.items()}))
    return out


def _lists(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and vectors of a column by length, as ``_strips``."""
    offsets, values = column.offsets.to_numpy(), column.values
    nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (nulls[offsets[1:]] == nulls[offsets[:-1]])
    numbers = values.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    of = {int(d): np.flatnonzero(whole & (lengths == d)) for d in np.unique(lengths[whole]) if d}
    return {d: (rows, numbers[offsets[rows][:, None] + np.arange(d)]) for d, rows in of.items()}


def _cosines(a: np.ndarray, b: np.ndarray, digits: int) -> np.ndarray:
    """``exprs.cosine`` of each row of a and each of b, rounded."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
        return rounded(np.where(norm <= 0, 0.0, a @ b.T / norm), digits)


def _scores(held: dict[int, tuple[np.ndarray, np.ndarray]], n: int, strip: tuple, digits: int, near: np.ndarray | None = None) -> np.ndarray:
    """Of n rows and a strip's vectors, as ``exprs.cosine``; near: the pairs to measure, the others are -inf. Rows and vectors that are near none are not measured."""
    _, m, by = strip
    out = np.zeros((n, m))
    for d, (at, b) in by.items():
        if d in held:
            rows, a = held[d]
            i, j = (slice(None), slice(None)) if near is None else (near[np.ix_(rows, at)].any(1), near[np.ix_(rows, at)].any(0))
            out[np.ix_(rows[i], at[j])] = _cosines(a[i], b[j], digits)
    if near is not None:
        out[~near] = -np.inf
    return out


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer tasks than cores is dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _nearest(vectors: DataFrame, part: DataFrame, k: int, digits: int, pairs: str = "") -> DataFrame:
    """(query_id, id, score, rank) of the k nearest of vectors to each of part's queries, a block that the driver holds.

    Tasks multiply their rows with strips of queries, and shuffle of each batch of rows the k nearest of a query only. pairs: with
    "home", vectors and queries have cell, and only those of one cell meet; with "reach" vectors have cell and far, queries angles and reach,
    and a pair beyond reach isn't measured.
    """
    asked = sorted(part.collect(), key=lambda r: -1 if r["cell"] is None else r["cell"]) if pairs == "home" else part.collect()
    strips = _strips([r["query"] for r in asked])
    angles = [r["angles"] and np.array(r["angles"], dtype=float) for r in asked] if pairs == "reach" else []
    reach = [r["reach"] for r in asked] if pairs == "reach" else []
    home = np.array([r["cell"] for r in asked], dtype=float) if pairs == "home" else None

    def met(batch: pa.RecordBatch, first: int, m: int) -> np.ndarray | None:
        if not pairs:
            return None
        cell, far = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("cell", "far"))
        if home is not None:
            return cell[:, None] == home[first : first + m]
        near = np.ones((len(cell), m), dtype=bool)
        placed = np.flatnonzero(~np.isnan(cell))
        for j in range(m):
            if angles[first + j] is not None:
                near[placed, j] = np.abs(angles[first + j][cell[placed].astype(int)] - far[placed]) <= reach[first + j]
        return near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.array_sort_indices(batch.column("id"), null_placement="at_start"))
            held, n = _lists(batch.column("embedding")), batch.num_rows
            for strip in strips:
                score = _scores(held, n, strip, digits, met(batch, *strip[:2]))
                by = np.where(np.isnan(score), np.inf, score)
                take = by > -np.inf
                if n > k:
                    least = np.partition(by, n - k, axis=0)[n - k]
                    ties = by == least
                    take &= (by > least) | ties & (np.cumsum(ties, axis=0) <= k - (by > least).sum(0))
                rows, at = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(at + strip[0], pa.int32()), batch.column("id").take(pa.array(rows)), pa.array(score[rows, at])], names=["at", "id", "score"])

    schema = T.StructType([T.StructField("at", T.IntegerType()), vectors.schema["id"], T.StructField("score", T.DoubleType())])
    found = vectors.select("id", "embedding", *(("cell", "far") if pairs else ())).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), F.asc("id")))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    known = T.StructType([T.StructField("at", T.IntegerType()), part.schema["query_id"]])
    ids = part.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], known)
    return best.join(F.broadcast(ids), "at").select("query_id", "id", "score", "rank")


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score) for each of the queries (query_id, query). All rows are scanned once for each block of queries, whose answers are staged."""
    out, parts = None, blocks(queries, "query_id")
    vectors = _spread(vectors.select("id", "embedding"))
    for part in parts:
        found = _nearest(vectors, part, k, digits)
        found = stage(found, "nearest") if len(parts) > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def _has_angle(v: Column) -> Column:
    """Vectors that have an angle to others: not null, empty, zero, or of components that are no numbers."""
    square = F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.coalesce((square > 0) & (square < 1e300), F.lit(False))


def choose_pivots(vectors: DataFrame, n: int = PIVOTS) -> DataFrame:
    """One staged row, pivots: the vectors of n ids that come first by hash, of those the ones that are as long as the first."""
    first = vectors.filter(_has_angle(F.col("embedding"))).orderBy(F.xxhash64("id"), "id").limit(n)
    one = first.agg(F.collect_list("embedding").alias("held"))
    return stage(one.select(F.filter("held", lambda v: F.size(v) == F.size(F.get("held", F.lit(0)))).alias("pivots")), "pivots")


def with_cells(vectors: DataFrame, pivots: DataFrame, vector: str = "embedding") -> DataFrame:
    """vectors with ``angles`` to the pivots, ``cell``, the nearest one's number, and ``far``, its angle: null for vectors without an angle to them."""
    v = F.col(vector)
    known = _has_angle(v) & (F.size(v) == F.size(F.get("pivots", F.lit(0))))
    angle = F.transform("pivots", lambda p: F.acos(clamp(cosine(v, p), -1.0, 1.0)))
    out = vectors.crossJoin(F.broadcast(pivots)).withColumn("angles", F.when(known, angle)).drop("pivots")
    return out.withColumn("far", F.array_min("angles")).withColumn("cell", (F.array_position("angles", F.col("far")) - 1).cast("int"))


def within_reach(cells: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of rows and queries (query_id, query, angles, reach) that the triangle inequality of angles can't rule out.

    A row's angle to a query is at least what their angles to the row's pivot differ by. Rows and queries without cells meet all.
    """
    least = F.abs(F.get("_angles", F.col("cell")) - F.col("far"))
    near = F.col("cell").isNull() | F.col("_angles").isNull() | (least <= F.col("reach"))
    return cells.join(F.broadcast(queries.withColumnRenamed("angles", "_angles")), near)


def reaches(cells: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Staged queries with ``reach``, an angle beyond which no row is among a query's k nearest: the k-th of its own cell, or all where that has fewer."""
    best = _nearest(cells, queries, k, digits, "home")
    last = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    angle = F.acos(clamp(F.col("least") - 10.0**-digits, -1.0, 1.0))
    reach = F.coalesce(angle, F.lit(np.pi)) + SLACK
    return stage(queries.join(last, "query_id", "left").select("query_id", "query", "angles", reach.alias("reach")), "reaches")


def top_k_by_pivots(cells: DataFrame, pivots: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``top_k_each``, with the same rows, over vectors that ``with_cells`` has stored: cosines are computed only within reach.

    It pays where vectors lie in clusters. Vectors aren't shuffled: a block's queries, their angles and their reaches are broadcast.
    """
    out, parts = None, blocks(queries, "query_id")
    for part in parts:
        asked = stage(with_cells(part.select("query_id", "query"), pivots, "query"), "asked")
        found = _nearest(cells, reaches(cells, asked, k, digits), k, digits, "reach")
        found = stage(found, "nearest") if len(parts) > 1 else found
        out = found if out is None else out.unionByName(found)
    return out


def boost(depth: Column) -> Column:
    out = F.lit(0.0)
    for d, b in GRAPH_BOOST:
        out = F.when(depth == d, F.lit(b)).otherwise(out)
    return out


def hybrid_top_k(vectors: DataFrame, distance: DataFrame, query: list[float], k: int, digits: int = 6) -> DataFrame:
    """top_k by cosine and a boost for nodes near a source; distance: id, depth."""
    near = similarity(vectors, query).join(distance, "id", "left")
    return near.withColumn("score", F.round(F.col("score") + boost(F.coalesce("depth", F.lit(0))), digits)).orderBy(F.desc("score"), F.asc("id")).limit(k)


def hybrid_top_k_each(vectors: DataFrame, distance: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, rank, id, score) of ``hybrid_top_k`` for each of the queries (query_id, query); distance: query_id, id, depth.

    A row without a boost is among a query's k only if it is among the k nearest, so only these and the boosted rows are ranked
    together, and the pairs of all rows and queries are never joined with distances.
    """
    lifted = distance.withColumn("lift", boost(F.col("depth"))).filter("lift > 0")
    lifted = lifted.join(queries.select("query_id", "query"), "query_id").join(vectors.select("id", "embedding"), "id")
    lifted = stage(lifted.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query")) + F.col("lift"), digits).alias("score")), "lifted")
    plain = top_k_each(vectors, queries, k, digits).select("query_id", "id", "score")
    both = plain.join(lifted, ["query_id", "id"], "left_anti").unionByName(lifted)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


class CachedEmbedder:
    """An embedder that keeps the vectors of the last texts it was asked for one by one, as searches do; batches pass through."""

    def __init__(self, embed: Callable[[list[str]], list[list[float]]], most: int = 1024):
        self.embed, self.one = embed, lru_cache(most)(lambda text: tuple(embed([text])[0]))

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [list(self.one(texts[0]))] if len(texts) == 1 else self.embed(texts)


def search_text(vectors: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], k: int, exclude: str | None = None) -> DataFrame:
    """top_k for a text; ``exclude`` is dropped after the cut, so there may be one row less."""
    found = top_k(vectors, embed([text])[0], k)
    return found if exclude is None else found.filter(F.col("id") != exclude)


def related(vectors: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], k: int, own: str) -> DataFrame:
    return search_text(vectors, text, embed, k + 1, own)


def assign(items: DataFrame, sections: DataFrame, digits: int = 6) -> DataFrame:
    """(id, section_id, score): the section of highest positive cosine of each item; ties to the first section. sections: section_id, ord, vector; items meet them block by block."""
    out, items = None, _spread(items.select("id", "embedding"))
    schema = T.StructType([items.schema["id"], T.StructField("at", T.IntegerType()), T.StructField("score", T.DoubleType())])
    for part in blocks(sections, "section_id"):
        ordered = part.orderBy(F.asc_nulls_last("ord"), F.desc("section_id")).collect()
        ids = part.sparkSession.createDataFrame([(i, r["ord"], r["section_id"]) for i, r in enumerate(ordered)], T.StructType([T.StructField("at", T.IntegerType()), part.schema["ord"], part.schema["section_id"]]))

        def run(batches: Iterator[pa.RecordBatch], strips: list = _strips([r["vector"] for r in ordered])) -> Iterator[pa.RecordBatch]:  # noqa: B008
            for batch in batches:
                held, n = _lists(batch.column("embedding")), batch.num_rows
                best, at = np.zeros(n), np.zeros(n, dtype=np.int32)
                for strip in strips:
                    score = _scores(held, n, strip, digits)
                    score[np.isnan(score)] = np.inf
                    j = score.argmax(1)
                    top = score[np.arange(n), j]
                    at, best = np.where(top > best, j + strip[0], at).astype(np.int32), np.maximum(top, best)
                hit = np.flatnonzero(best > 0)
                told = np.where(np.isinf(best), np.nan, best)[hit]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(hit)), pa.array(at[hit], pa.int32()), pa.array(told)], names=["id", "at", "score"])

        scored = items.mapInArrow(run, schema).join(F.broadcast(ids), "at")
        best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "section_id")).alias("b"))
        out = best if out is None else out.unionByName(best).groupBy("id").agg(F.max("b").alias("b"))
    return out.select("id", F.col("b.section_id").alias("section_id"), F.col("b.score").alias("score"))


def index_health(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row from two tables of ids: expected, indexed, missing, stale, coverage, freshness, stale_ratio, rebuild."""
    e, i = expected.select("id").distinct().withColumn("e", F.lit(1)), indexed.select("id").distinct().withColumn("i", F.lit(1))
    both = e.join(i, "id", "full_outer")
    n = both.agg(F.count("e").alias("expected"), F.count("i").alias("indexed"), F.count_if(F.col("e").isNotNull() & F.col("i").isNotNull()).alias("both"))
    n = n.withColumn("missing", F.col("expected") - F.col("both")).withColumn("stale", F.col("indexed") - F.col("both"))
    cover = F.when(F.col("expected") == 0, 1.0).otherwise(clamp(F.col("both") / F.col("expected"), 0.0, 1.0))
    most = F.greatest("expected", "indexed")
    fresh = F.when(most == 0, 1.0).otherwise(clamp(1 - (F.col("missing") + F.col("stale")) / most, 0.0, 1.0))
    ratio = F.when(F.col("indexed") == 0, 0.0).otherwise(clamp(F.col("stale") / F.col("indexed"), 0.0, 1.0))
    n = n.withColumns({"coverage": F.round(cover, 6), "freshness": F.round(fresh, 6), "stale_ratio": F.round(ratio, 6)})
    bad = (F.col("freshness") < FRESH) | (F.col("coverage") < COVERED) | (F.col("stale_ratio") > STALE)
    return n.withColumn("rebuild", (F.col("indexed") == 0) | ((F.col("expected") > 0) & bad)).drop("both")


def missing_and_stale(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, state) of ids that only one side has."""
    e, i = expected.select("id").distinct(), indexed.select("id").distinct()
    return e.join(i, "id", "left_anti").withColumn("state", F.lit("missing")).unionByName(i.join(e, "id", "left_anti").withColumn("state", F.lit("stale")))


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder without a model: signed counts of words, scaled to length 1."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dimension)
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return embed


def embed_column(df: DataFrame, text: Column, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """df with ``embedding``; the embedder gets batches of texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows = s.tolist()
            yield pd.Series([v for i in range(0, len(rows), batch) for v in embed(rows[i : i + batch])])

    return df.withColumn("embedding", run(text))
