import pytest

from weftline.llm import skew


@pytest.mark.parametrize(("least", "most"), [(10_000, 10_000), (5, 3), (0, 10_000)])
def test_hot_keys_join_like_others(spark, monkeypatch, least, most):
    """A key of a third of the rows, others, one that only the table has, and null keys."""
    monkeypatch.setattr(skew, "LEAST_HOT", least)
    monkeypatch.setattr(skew, "MOST_HOT", most)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 7}" if i % 5 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, k string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), *((f"k{i}", i) for i in range(9))], "k string, v int")
    counts = df.groupBy("k").count().withColumnRenamed("count", "n")
    got = sorted((r.id, r.k, r.v) for r in skew.attach(df, table, "k", counts).collect())
    assert got == sorted((i, k, v) for i, k in rows for t, v in [("hot", 1), ("hot", 2), *((f"k{j}", j) for j in range(9))] if t == k)
    assert skew.attach(df.limit(0), table, "k", counts.limit(0)).count() == 0
