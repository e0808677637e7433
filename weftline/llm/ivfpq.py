"""Approximate nearest neighbours: inverted file, product-quantised residuals, asymmetric tables, exact reranking.

Coarse centroids and residual codebooks are fitted by k-means on a bounded sample: FIT_EACH
vectors for each coarse centroid, FIT_ROWS at least and MOST_FIT_ROWS at most. There are as
many lists as the square root of the number of vectors; beyond MAX_COARSE centroids, a list
is a centroid and one of a second codebook of residuals, so lists grow on without limit.
Every vector is indexed: it goes to its list with a code of its residual's nearest codewords.

A query probes the lists nearest to it (as many as find ``target`` of the true neighbours
within the sample). In each, a table of distances from the query's residual to all codewords
(asymmetric distances) ranks the codes. Of all probed lists together only the ``rerank`` best
ids of a query go on: the nearest one in HEAD of its lists comes first, and its rerank-th
best distance bounds what the other lists return. Only then are vectors fetched, by id, and
measured exactly in double precision. Ties go to the smaller id at every cut.

Ids and codes are shuffled, never vectors with them. A list of many codes is split into
shards of SHARD_ROWS, and meets its queries in blocks of QUERY_ROWS. Of equal vectors the
k + 1 smallest ids are indexed, since no answer can hold more of them, and equal queries are
asked once, so a vector that a third of all rows share is a few rows. What is broadcast is
the quantiser, bounded as above, and one number for each list that is split.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do null ids. Vectors of another dimension have no distance to a query: each dimension is an
index of its own, one after the other, so dimensions should be few. Rows that repeat an id
act as one id at the least distance, and count once against every limit. An empty table
gives no rows; further columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.skew import attach
from weftline.staging import stage

K = 10
FIT_ROWS, FIT_EACH, MOST_FIT_ROWS = 16_384, 32, 131_072
MAX_COARSE = 4096
#: Parts of a code: PARTS at least, and one for each PART_DIMENSIONS dimensions.
PARTS, PART_DIMENSIONS, CODEWORDS = 32, 8, 256
#: Ids of a query whose vectors are measured.
RERANK = 64
#: Part of the nearest rows whose lists the probes must reach, measured on the sample.
TARGET = 0.97
QUERY_ROWS, SHARD_ROWS = 4096, 65_536
#: Part of the probes that go first, to bound the others.
HEAD = 32
#: Distances that are held at once.
_CELLS = 4_000_000
ROUNDS = 8


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, in blocks."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most k centres; a centre that loses its rows moves to the row that is furthest from its own."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))]
    if len(centres) == len(distinct):
        return centres
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        some = np.flatnonzero(count)
        order = np.argsort(own, kind="stable")
        means = np.add.reduceat(x[order], (np.cumsum(count) - count)[some], axis=0) / count[some, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            far = np.argsort(-((x - centres[own]) ** 2).sum(axis=1), kind="stable")
            centres[empty] = x[far[: len(empty)]]
        centres[some] = means
    return centres


class Quantizer:
    """Coarse and fine centroids, and codebooks of residuals by parts of the dimension. List c * fine + f has the centre coarse[c] + fine[f]."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, codewords: int = CODEWORDS, max_coarse: int = MAX_COARSE):
        self.coarse = kmeans(sample, min(lists, max_coarse))
        at = _nearest(sample, self.coarse)
        residual = sample - self.coarse[at]
        fine = -(-lists // len(self.coarse)) if lists > max_coarse else 1
        self.fine = kmeans(residual, fine) if fine > 1 else np.zeros((1, sample.shape[1]))
        self.cross = self.coarse @ self.fine.T
        residual = residual - self.fine[_nearest(residual, self.fine)]
        dimension = sample.shape[1]
        cuts = np.array_split(np.arange(dimension), min(max(parts, dimension // PART_DIMENSIONS), dimension))
        self.parts = [slice(c[0], c[-1] + 1) for c in cuts]
        self.books = [kmeans(residual[:, p], codewords, 5) for p in self.parts]
        self.squares = [(b * b).sum(axis=1)[:, None] for b in self.books]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists(self, x: np.ndarray) -> np.ndarray:
        at = _nearest(x, self.coarse)
        return at * len(self.fine) + _nearest(x - self.coarse[at], self.fine)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.centre(lists)
        return np.stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n lists of nearest centres of each row, nearest first."""
        c = ((self.coarse * self.coarse).sum(axis=1) / 2 - x @ self.coarse.T)[:, :, None]
        f = ((self.fine * self.fine).sum(axis=1) / 2 - x @ self.fine.T)[:, None, :]
        distance = (c + f + self.cross).reshape(len(x), -1)
        return np.argsort(distance, axis=1, kind="stable")[:, :n]

    def probes_for(self, sample: np.ndarray, target: float, k: int, queries: int = 256) -> int:
        """Probes that reach ``target`` of the k nearest sample rows of up to ``queries`` sample rows."""
        at, need = self.lists(sample), []
        square = (sample * sample).sum(axis=1)
        for i in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
            distance = square - 2 * (sample @ sample[i])
            distance[i] = np.inf
            near = np.argsort(distance, kind="stable")[: min(k, len(sample) - 1)]
            rank = np.empty(len(self.coarse) * len(self.fine), np.int64)
            rank[self.probes(sample[i : i + 1], len(rank))[0]] = np.arange(len(rank))
            need += rank[at[near]].tolist()
        return int(np.quantile(need, target, method="higher")) + 1 if need else 1

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """(queries x codes): squared distances from each query's residual in list ``at`` to what codes stand for, added up from a table of each part."""
        r = x - self.centre(np.array([at]))
        out = np.zeros((len(codes), len(x)), np.float32)
        for i, (p, b, square) in enumerate(zip(self.parts, self.books, self.squares, strict=True)):
            table = (square - 2 * (b @ r[:, p].T) + (r[:, p] ** 2).sum(axis=1)).astype(np.float32)
            out += table[codes[:, i]]
        return out.T


def _usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    kind = df.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding"))
    return rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & finite & F.exists(e, lambda v: v != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _lists_of(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with ``key``, a digest of the vector, and its dimension ``n``; of rows that a batch repeats, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column("vec_id").to_pylist(), b.column("embedding")
            ends = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            flat = vectors.flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            keys = [hashlib.blake2b(flat[i:j].tobytes(), digest_size=16).digest() for i, j in zip(ends, ends[1:], strict=False)]
            first = {pair: i for i, pair in reversed(list(enumerate(zip(ids, keys, strict=True))))}
            at = pa.array(sorted(first.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), vectors.take(at), pa.array(keys, pa.binary()).take(at), vectors.value_lengths().take(at)], names=["vec_id", "embedding", "key", "n"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType())]))


def _index(rows: DataFrame, shared) -> DataFrame:
    """(vec_id, list, code) of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("embedding"))
                at = q.lists(x)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at.astype(np.int64)), pa.array([c.tobytes() for c in q.codes(x, at)], pa.binary())], names=["vec_id", "list", "code"])

    return rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, list long, code binary")


def _probed(queries: DataFrame, shared, probes: int) -> DataFrame:
    """A row for each query (its key) and list that it probes; ``probe`` is 0 for the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                x = _matrix(part.column("embedding"))
                lists = q.probes(x, probes)
                row = np.repeat(np.arange(len(x)), lists.shape[1])
                probe = np.tile(np.arange(lists.shape[1], dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), _lists_of(x[row].astype(np.float32)), pa.array(lists.ravel().astype(np.int64)), pa.array(probe)], names=["key", "query", "list", "probe"])

    return queries.select("key", "embedding").mapInArrow(run, "key binary, query array<float>, list long, probe int")


def _best(q: Quantizer, at: int, ids: np.ndarray, codes: np.ndarray, queries: np.ndarray, bounds: np.ndarray, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's number, id, asymmetric distance): for each query the ``rerank`` best ids of a list, none over its bound."""
    order = np.argsort(ids, kind="stable")
    ids, codes = ids[order], codes[order]
    each, start = np.unique(ids, return_index=True)
    step = max(1, min(256, _CELLS // len(ids)))
    for i in range(0, len(queries), step):
        near = q.distances(queries[i : i + step], at, codes)
        if len(each) < len(ids):  # an id counts once, at its nearest row
            near = np.minimum.reduceat(near, start, axis=1)
        inside = near <= bounds[i : i + step, None]
        for j in np.flatnonzero(inside.sum(axis=1) > rerank):
            pick = np.flatnonzero(inside[j])
            distance = near[j, pick]
            cut = np.partition(distance, rerank - 1)[rerank - 1]
            closer, level = pick[distance < cut], pick[distance == cut]
            inside[j] = False
            inside[j, closer] = inside[j, level[: rerank - len(closer)]] = True
        row, column = np.nonzero(inside)
        yield row + i, each[column], near[row, column]


def _scan(probed: DataFrame, index: DataFrame, shared, rerank: int) -> DataFrame:
    """(key, vec_id, near): candidates of each query from its lists. probed: key, query, list, bound."""
    large = lambda df, rows, name: F.broadcast(df.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows).select("list", F.ceil(F.col("n") / rows).cast("int").alias(name)))
    shards, blocks = large(index, SHARD_ROWS, "shards"), large(probed, QUERY_ROWS, "blocks")
    number = lambda c: F.coalesce(F.col(c), F.lit(1))
    each = lambda c: F.explode(F.sequence(F.lit(0), number(c) - 1))
    with_both = lambda df: df.join(shards, "list", "left").join(blocks, "list", "left")
    codes = with_both(index).select("list", "vec_id", "code", F.pmod(F.xxhash64("vec_id"), number("shards")).cast("int").alias("shard"), each("blocks").alias("block"))
    asked = with_both(probed).select("list", "key", "query", "bound", F.pmod(F.xxhash64("key"), number("blocks")).cast("int").alias("block"), each("shards").alias("shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["key", "vec_id", "near"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.binary(), pa.int64(), pa.float32())], names=names)
        words = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        bounds = left.column("bound").to_numpy()
        found = list(_best(shared.value, right.column("list")[0].as_py(), right.column("vec_id").to_numpy(), words, _matrix(left.column("query")), np.where(np.isnan(bounds), np.inf, bounds), rerank))
        row, ids, near = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([left.column("key").combine_chunks().take(pa.array(row)), ids, near], names=names)

    on = ["list", "shard", "block"]
    return asked.groupBy(*on).cogroup(codes.groupBy(*on)).applyInArrow(run, "key binary, vec_id long, near float")


def _ranked(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each ``by`` in the order of (order, vec_id), with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, "vec_id"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= most)


def _sample(rows: DataFrame, total: int, wanted: int) -> np.ndarray:
    """Vectors of a cut of a hash that keeps ``wanted`` on average, and at most an eighth more."""
    part = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, wanted / total) * (1 << 30))
    some = (rows.filter(part) if total > wanted else rows).select("embedding").limit(wanted + wanted // 8).toArrow()
    some = some if some.num_rows else rows.select("embedding").limit(1).toArrow()
    return np.unique(_matrix(some.column("embedding")), axis=0)


def _search_one(rows: DataFrame, every: int, k: int, lists: int | None, probes: int | None, rerank: int, target: float) -> DataFrame:
    """search() over the vectors of one dimension: vec_id, key, embedding."""
    spark = rows.sparkSession
    first = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))
    kept = stage(rows.withColumn("first", first).filter(F.col("first") <= k + 1).dropDuplicates(["key", "vec_id"]), "vectors")
    total = kept.count()
    lists = lists or max(1, round(total**0.5))
    sample = _sample(kept, total, max(FIT_ROWS, min(FIT_EACH * lists, MOST_FIT_ROWS)))
    quantizer = Quantizer(sample, lists)
    probes = probes or quantizer.probes_for(sample, target, k)
    shared = spark.sparkContext.broadcast(quantizer)
    index = stage(_index(kept, shared), "index")
    members = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key").distinct()
    queries = kept.filter("first = 1").join(members.select("key"), "key", "left_semi").select("key", "embedding")
    probed = stage(_probed(queries, shared, probes), "probed")
    head = -(-probes // HEAD)
    best = lambda df, most: _ranked(df.groupBy("key", "vec_id").agg(F.min("near").alias("near")), "key", "near", most)
    near = _scan(probed.filter(F.col("probe") < head).withColumn("bound", F.lit(float("inf")).cast("float")), index, shared, rerank)
    if head < probes:
        near = stage(near, "near")
        bound = best(near, rerank).filter(F.col("rank") == rerank).select("key", F.col("near").alias("bound"))
        near = near.unionByName(_scan(probed.filter(F.col("probe") >= head).join(bound, "key", "left"), index, shared, rerank))
    candidates = best(near, rerank).select("key", "vec_id")
    pairs = candidates.join(queries.withColumnRenamed("embedding", "query"), "key").join(kept.select("vec_id", "embedding"), "vec_id")
    square = F.aggregate(F.zip_with("embedding", "query", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0).cast("double"), lambda s, v: s + v)
    measured = pairs.select("key", "vec_id", F.sqrt(square).alias("score")).groupBy("key", "vec_id").agg(F.min("score").alias("score"))
    answers = stage(_ranked(measured, "key", "score", k + 1).drop("rank"), "answers")
    found = attach(members, answers, "key", members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))).filter("vec_id <> query_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return _ranked(found, "query_id", "score", k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = K, lists: int | None = None, probes: int | None = None, rerank: int = RERANK, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``, against all rows but its own."""
    rows = stage(_keyed(_usable(df, vec_id, embedding)), "rows")
    sizes = [r["n"] for r in rows.select("n").distinct().orderBy("n").collect()]
    out = None
    for n in sizes:
        found = _search_one(rows.filter(F.col("n") == n).drop("n"), every, k, lists, probes, rerank, target)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out
