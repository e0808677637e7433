"""Centroid clustering of integer vectors, screened by the norms of their blocks.

Components become integers ``floor(scale * x)``, so sums, means and distances are exact and every run
and every dealing of the rows gives the same clusters. A vector is staged once as packed integers and
compressed to the norms of its blocks, taken about an integer centre (the mean of the starting
centroids), which moves no distance. By Cauchy and Schwarz, ``sum((|v_b| - |c_b|) ** 2)`` over the blocks b is
a lower bound of the squared distance. A task computes these bounds for its vectors and all
centroids by one small product, measures the centroid of the least bound (or that of the round
before, staged with the vectors in a driver's table of centroids only), and then measures exactly, in
integers, just the centroids whose bound doesn't exceed the best distance so far.

A round reads the staged vectors, leaves one partial sum for each task and centroid, and adds these
up in Spark; the driver holds the centroids and nothing else, ``clusters * dimension`` numbers. Nothing is sorted or
shuffled by cluster, so a cluster with most of the rows is no hot key.

Vectors of another length, null ones, and those with null or non-finite components take no part. A
component over ``MOST`` (2 million before scaling by 64) would overflow a distance of 64-bit integers: such a vector
is returned with a null cluster and distance, and moves no centroid. A null id is an id, and comes last among the
starting candidates; equal ids are ordered by their vectors. Fewer vectors than clusters make fewer
clusters; no vectors, no rows. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.workers import trimmed
from weftline.staging import drop, stage

DIMENSION, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
BLOCKS = 16
#: Largest magnitude of a component: then a squared distance is below 64 * 2**56.
MOST = 2**27
_ROWS = 8192


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly where scale is a power of two."""
    return np.floor(values.astype(np.float64) * scale)


def norms(vectors: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """The Euclidean norm of each of a vector's blocks."""
    return np.sqrt(np.square(vectors.astype(np.float64)).reshape(len(vectors), blocks, -1).sum(axis=2))


def bounds(own: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Lower bounds of squared distances from block norms, below the true bound by more than rounding can lift them."""
    squares = np.square(own).sum(axis=1)[:, None] + np.square(theirs).sum(axis=1)
    return squares - 2 * (own @ theirs.T) - 1e-9 * squares - 1e-6


def nearest(vectors: np.ndarray, own: np.ndarray, centroids: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, distance) of each vector, ties to the smaller number, and how many distances were measured."""
    low = bounds(own, theirs)
    best = low.argmin(axis=1)
    least = np.square(vectors - centroids[best]).sum(axis=1)
    measured = len(vectors)
    first = best.copy()
    for c in range(len(centroids)):
        at = np.flatnonzero((low[:, c] <= least) & (first != c))
        distance = np.square(vectors[at] - centroids[c]).sum(axis=1)
        better = (distance < least[at]) | ((distance == least[at]) & (c < best[at]))
        best[at[better]], least[at[better]] = c, distance[better]
        measured += len(at)
    return best, least, measured


def _kept(df: DataFrame, vec_id: str, embedding: str, dimension: int) -> DataFrame:
    """(vec_id, e): vectors that take part, as doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    return rows.filter((F.size("e") == dimension) & F.forall("e", finite))


def _packed(rows: DataFrame, dimension: int, scale: int) -> DataFrame:
    """(vec_id, code): 32-bit integers, null where a component is over MOST."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = integers(b.column("e").flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dimension)
            fits = (np.abs(e) <= MOST).all(axis=1)
            whole = np.where(fits[:, None], e, 0).astype("<i4")
            codes = [v.tobytes() if f else None for v, f in zip(whole, fits.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(codes, pa.binary())], names=["vec_id", "code"])

    return rows.mapInArrow(trimmed(run), f"vec_id {kind}, code binary")


def _vectors(codes: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), "<i4").reshape(-1, dimension).astype(np.int64)


def starts(packed: DataFrame, dimension: int, clusters: int, seed: str) -> np.ndarray:
    """The vectors of the smallest hashes of seed and id, in the order of these."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).asc_nulls_last()
    first = packed.filter(F.col("code").isNotNull()).orderBy(order, "code").limit(clusters).collect()
    return np.array([np.frombuffer(r.code, "<i4") for r in first], np.int64).reshape(-1, dimension)


def _compressed(packed: DataFrame, centre: np.ndarray, dimension: int, blocks: int) -> DataFrame:
    """packed with the norms of its blocks about the centre, made once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = norms(_vectors(b.column("code"), dimension) - centre, blocks)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in n], pa.binary())], names=["vec_id", "code", "norms"])

    kind = packed.schema["vec_id"].dataType.simpleString()
    return packed.filter(F.col("code").isNotNull()).mapInArrow(trimmed(run), f"vec_id {kind}, code binary, norms binary")


class Assigner:
    """Assigns batches of vectors to centroids; it is what a task needs."""

    def __init__(self, centroids: np.ndarray, centre: np.ndarray, dimension: int, blocks: int):
        self.centroids, self.dimension, self.blocks = centroids, dimension, blocks
        self.norms = norms(centroids - centre, blocks)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(part of the batch, its vectors, clusters, distances, distances measured)."""
        for i in range(0, batch.num_rows, _ROWS):
            part = batch.slice(i, _ROWS)
            vectors = _vectors(part.column("code"), self.dimension)
            own = np.frombuffer(b"".join(part.column("norms").to_pylist())).reshape(-1, self.blocks)
            yield part, vectors, *nearest(vectors, own, self.centroids, self.norms)


def _summed(vectors: DataFrame, assign: Assigner) -> DataFrame:
    """For each centroid with vectors: cluster, n, measured, and sums as decimals. A task leaves a row for each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(assign.centroids)
        sums, counts, measured = np.zeros((k, assign.dimension), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            for _, v, cluster, _, m in assign.parts(b):
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(v[order], first, axis=0)
                counts += np.bincount(cluster, minlength=k)
                measured += m
        some = np.flatnonzero(counts)
        columns = [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(np.where(some == some.min(initial=0), measured, 0)), pa.array(sums[some].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "measured", "sums"])

    parts = vectors.select("code", "norms").mapInArrow(trimmed(run), "cluster int, n long, measured long, sums array<long>")
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(assign.dimension)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("measured").alias("measured"), *sums)


def _assigned(vectors: DataFrame, assign: Assigner) -> DataFrame:
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, cluster, distance, _ in assign.parts(b):
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(trimmed(run), f"vec_id {kind}, cluster int, distance long")


class Clusters:
    """Final centroids, the table (vec_id, cluster, distance), and for each round how many of the distances were measured."""

    def __init__(self, centroids: np.ndarray, rows: DataFrame, measured: list[float]):
        self.centroids, self.rows, self.measured = centroids, rows, measured


def fit(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimension: int = DIMENSION, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, blocks: int = BLOCKS) -> Clusters:
    """Assigns and moves centroids ``rounds`` times, then assigns once more."""
    packed = stage(_packed(_kept(df, vec_id, embedding, dimension), dimension, scale), "packed")
    centroids = starts(packed, dimension, clusters, seed)
    wide = packed.filter(F.col("code").isNull()).select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    if not len(centroids):
        return Clusters(centroids, wide, [])
    centre = centroids.sum(axis=0) // len(centroids)
    vectors = stage(_compressed(packed, centre, dimension, blocks), "compressed")
    shares = []
    for _ in range(rounds):
        moved = centroids.copy()
        found = _summed(vectors, Assigner(centroids, centre, dimension, blocks)).collect()  # a row for each centroid
        for r in found:
            moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dimension)]
        shares.append(sum(r.measured for r in found) / (sum(r.n for r in found) * len(centroids)))
        centroids = moved
    rows = stage(_assigned(vectors, Assigner(centroids, centre, dimension, blocks)).unionByName(wide), "clusters")
    drop(packed, vectors)
    return Clusters(centroids, rows, shares)


def summary(found: Clusters) -> DataFrame:
    """rows with cluster_inertia, inertia (null where over a long) and centroid_sha256."""
    spark = found.rows.sparkSession
    whole = lambda c: F.expr(f"try_cast({c} AS long)")
    inertia = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    total = sum(int(r.s) for r in inertia if r.s is not None)
    text = [",".join(map(str, c)) for c in found.centroids.tolist()]
    named = [(r.cluster, str(int(r.s)), str(total), hashlib.sha256(text[r.cluster].encode()).hexdigest()) for r in inertia if r.cluster is not None]
    beside = spark.createDataFrame(named, "cluster int, own string, total string, centroid_sha256 string")
    beside = beside.select("cluster", whole("own").alias("cluster_inertia"), whole("total").alias("inertia"), "centroid_sha256")
    return found.rows.join(F.broadcast(beside), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(n: int) -> str:
    """SQL of a round: a<n> assigns to c<n>, c<n+1> are the moved centroids."""
    return f"""
a{n} AS MATERIALIZED (SELECT vec_id, e, min(16 * list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(e, ce)]) + c)::BIGINT AS best FROM v, c{n} GROUP BY r, vec_id, e),
s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best % 16 AS c, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{n}) GROUP BY c, i),
m{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS me FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(me, ce) AS ce FROM c{n} LEFT JOIN m{n} ON c{n}.c = m{n}.c),"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e AS ce FROM (SELECT *, sha256('1:' || vec_id::VARCHAR) AS h FROM v) ORDER BY h, e LIMIT 16),
{"".join(_round(n) for n in range(ROUNDS))}
f AS (SELECT vec_id, r, min(16 * list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(e, ce)]) + c)::BIGINT AS best FROM v, c{ROUNDS} GROUP BY r, vec_id)
SELECT vec_id, (best % 16)::INT AS cluster, best // 16 AS distance, (sum(best // 16) OVER (PARTITION BY best % 16))::BIGINT AS cluster_inertia,
  (sum(best // 16) OVER ())::BIGINT AS inertia, sha256(array_to_string(ce, ',')) AS centroid_sha256
FROM f JOIN c{ROUNDS} ON best % 16 = c
"""
