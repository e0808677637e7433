import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import blocknorm
from weftline.llm.queries import op11_block_norm_clusters

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, clusters=16, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in Python's integers."""
    fit = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    named = sorted(fit, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    centroids = [e for _, e in named[:clusters]]

    def assign(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, e in fit:
            groups.setdefault(assign(e)[1], []).append(e)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    found = [(i, *assign(e)) for i, e in fit]
    own = {k: sum(d for _, d, c in found if c == k) for _, _, k in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, own[k], sum(own.values()), digest[k]) for i, d, k in found), key=str)


def clustered(df):
    return sorted(map(tuple, blocknorm.summary(blocknorm.fit(df)).collect()), key=str)


def corpus(n=300, seed=11):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i * 7, [m + rng.gauss(0, 0.2) for m in middles[i % 6]]) for i in range(n)]
    rows += [(i * 7 + 1, rows[i][1]) for i in range(20)]  # equal vectors
    rows += [(1001, [0.0] * 64), (1002, [1e4] * 64), (1003, [-0.015625] * 64), (1004, [math.nextafter(0.5, 0)] * 64)]
    odd = [(2001, None), (2002, [0.1] * 63), (2003, [0.1] * 65), (2004, [None, *[0.1] * 63]), (2005, [math.inf, *[0.1] * 63]), (2006, [math.nan, *[0.1] * 63]), (2007, [])]
    return rows + odd


@pytest.mark.parametrize("seed", [11, 12])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed=seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert clustered(df) == want
    assert clustered(df.repartition(7).withColumns({c: F.lit("x") for c in ("cluster", "code", "norms", "e")})) == want


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    """Two values in forty equal vectors: sixteen centroids, most of them equal and empty."""
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    got = clustered(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and len({r[1] for r in got}) == 2


def test_screening_measures_few_and_loses_none(spark):
    rng = np.random.default_rng(5)
    middles = rng.integers(-300, 300, (16, 64))
    vectors = middles[rng.integers(0, 16, 2000)] + rng.integers(-9, 9, (2000, 64))
    for centre in (np.zeros(64, np.int64), middles.sum(axis=0) // 16):
        own, theirs = (blocknorm.norms(x - centre) for x in (vectors, middles))
        exact = np.square(vectors[:, None, :] - middles).sum(axis=2)
        assert (blocknorm.bounds(own, theirs) <= exact).all()
        cluster, distance, measured = blocknorm.nearest(vectors, own, middles, theirs)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert measured < 0.3 * exact.size
    rows = [(i, (v / 64).tolist()) for i, v in enumerate(vectors)]
    measured = blocknorm.fit(spark.createDataFrame(rows, SCHEMA)).measured
    assert len(measured) == 3 and max(measured) < 0.9


def test_bounds_stay_below_where_norms_are_equal_or_huge():
    rng = np.random.default_rng(6)
    for size in (1, 100, 2**27):
        v, c = rng.integers(-size, size + 1, (300, 64)), rng.integers(-size, size + 1, (16, 64))
        c[:8] = v[:8] + (0 if size == 1 else 1)
        exact = np.square(v[:, None, :] - c).sum(axis=2)
        assert (exact >= 0).all() and (blocknorm.bounds(blocknorm.norms(v), blocknorm.norms(c)) <= exact).all()


def test_few_none_and_huge_vectors(spark):
    rows = [(3, [0.5] * 64), (None, [0.25] * 64), (3, [0.75] * 64)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = blocknorm.summary(blocknorm.fit(df)).collect()
    assert len(got) == 3 and {r.distance for r in got} == {0} and {r.cluster for r in got if r.vec_id is None} == {2}
    assert clustered(df.limit(0)) == []
    huge = spark.createDataFrame([*rows, (9, [1e300] * 64), (8, [3e6] * 64)], SCHEMA)
    assert {(r.vec_id, r.cluster, r.distance) for r in blocknorm.summary(blocknorm.fit(huge)).collect() if r.vec_id in (8, 9)} == {(9, None, None), (8, None, None)}
    assert len(clustered(huge.filter("vec_id > 7"))) == 2


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, op11_block_norm_clusters(spark, sf).collect()))
    assert got == sorted(c.sql("SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM (" + blocknorm.ORACLE + ")").fetchall())
