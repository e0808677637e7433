"""Search by pivots: the scan's answers, from fewer pairs."""

import numpy as np
from pyspark.sql import functions as F

from weftline.operators import vector

VECTORS = "id string, embedding array<float>"


def clustered(n=600, clusters=12, width=16):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(clusters, width))
    return [(f"v{i:03}", (centres[i % clusters] + 0.05 * rng.normal(size=width)).tolist()) for i in range(n)]


def answers(df):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())


def test_same_answers_from_under_half_of_the_pairs(spark):
    v = spark.createDataFrame(clustered(), VECTORS).repartition(4)
    q = v.filter(F.substring("id", 2, 3).cast("int") % 25 == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    pivots = vector.choose_pivots(v, 24)
    cells = vector.stage(vector.with_cells(v, pivots), "cells")
    assert answers(vector.top_k_by_pivots(cells, pivots, q, 5)) == answers(vector.top_k_each(v, q, 5))
    asked = vector.with_cells(q, pivots, "query")
    pairs = vector.within_reach(cells, vector.reaches(cells, asked, 5)).count()
    assert 24 * 5 <= pairs < 24 * 600 / 2


def test_odd_vectors_and_ties(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [1.0]), ("g", []), ("h", [-1.0, 0.0]), ("i", [1.0, float("nan")])]
    v = spark.createDataFrame(rows, VECTORS)
    q = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 0.0]), ("3", None), ("4", [5.0]), ("5", [-1.0, -1.0])], "query_id string, query array<float>")
    pivots = vector.choose_pivots(v, 3)
    for k in (1, 3, 20):
        got = answers(vector.top_k_by_pivots(vector.with_cells(v, pivots), pivots, q, k))
        assert repr(got) == repr(answers(vector.top_k_each(v, q, k)))
    none = v.limit(0)
    pivots = vector.choose_pivots(none)
    assert vector.top_k_by_pivots(vector.with_cells(none, pivots), pivots, q, 2).count() == 0


def test_no_pair_of_a_cell_or_within_reach_is_a_join(spark):
    v = spark.createDataFrame(clustered(60, 4), VECTORS)
    q = v.limit(3).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    pivots = vector.choose_pivots(v, 4)
    found = vector.top_k_by_pivots(vector.stage(vector.with_cells(v, pivots), "cells"), pivots, q, 2)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
