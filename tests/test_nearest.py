"""Searches by blocks of products give what the column expression of the cosine gives."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.exprs import cosine
from weftline.operators import vector

nan = float("nan")
ODD = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [1.0]), ("g", []), ("h", [-1.0, 1e-9]), ("i", [1.0, nan]), ("j", [None, 1.0]), (None, [1.0, 1.0]), ("é", [1.0, 0.0]), ("z", [3e38, 3e38])]


def table(spark):
    rng = np.random.default_rng(3)
    rows = ODD + [(f"r{i:03}", [float(x) for x in rng.integers(-2, 3, size=2)]) for i in range(120)]
    return spark.createDataFrame(rows, "id string, embedding array<float>").repartition(3)


def test_searches_and_assignment_equal_the_expression(spark, monkeypatch):
    monkeypatch.setattr(vector, "STRIP", 3)
    v = table(spark)
    q = spark.createDataFrame([(str(i), x) for i, (_, x) in enumerate(ODD)], "query_id string, query array<float>")
    pairs = v.crossJoin(q).withColumn("score", F.round(cosine(F.col("embedding"), F.col("query")), 6))
    for k in (1, 7, 500):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
        want = pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank")
        assert sorted(map(repr, vector.top_k_each(v, q, k).collect())) == sorted(map(repr, want.collect()))
    s = q.select(F.col("query_id").alias("section_id"), (F.col("query_id").cast("int") % 5).alias("ord"), F.col("query").alias("vector"))
    best = pairs.join(s, F.col("section_id") == F.col("query_id")).filter("score > 0").groupBy("id").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "section_id")).alias("b"))
    want = best.select("id", F.col("b.section_id").alias("section_id"), F.col("b.score").alias("score"))
    assert sorted(map(repr, vector.assign(v, s).collect())) == sorted(map(repr, want.collect()))


def test_rounding_equals_sparks(spark):
    x = [0.0000005, -0.0000005, 0.1234565, -0.9999995, 0.1, -1e-9, 2.5e-7, 0.3333335, 1.0, nan]
    want = [r[0] for r in spark.createDataFrame([(y,) for y in x], "x double").select(F.round("x", 6)).collect()]
    assert repr(vector.rounded(np.array(x), 6).tolist()) == repr(want)


def test_pairs_are_made_in_tasks_and_not_by_a_join(spark):
    """A join of all rows with all queries computes each cosine by an interpreted expression, of some 10 µs."""
    v = table(spark)
    q = v.limit(4).select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    s = q.select(F.col("query_id").alias("section_id"), F.lit(1).alias("ord"), F.col("query").alias("vector"))
    for df in (vector.top_k_each(v, q, 2), vector.assign(v, s)):
        assert "BroadcastNestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()
