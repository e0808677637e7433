import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 1}, {"a": 5, "b": 0, "é": 70, None: 3, "Z": 900}, {"x": 0}, {None: 10}])
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def corpus(spark, n=900):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), " ".join(["w"] * rng.choice([0, 1, 5, 50, 200])), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, taken string")


def test_words_taken_follow_targets(spark):
    rows, df = corpus(spark)
    out = mixing.mix(df).cache()
    assert out.columns == ["doc_id", "source", "text", "size", "source_size", "target", "copies", "taken"] and out.count() == len(rows)
    assert out.filter("copies < 0 OR taken > 3 * size OR taken <> copies * size").count() == 0
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= 2 * r.most
    again = mixing.mix(df.repartition(7)).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.select("doc_id", "taken").collect()))
    assert mixing.emit(out).count() == out.agg(F.sum("copies")).first()[0]
    out.unpersist()


def test_copies_are_integer_boundaries_of_the_prefix_sum(spark):
    _, df = corpus(spark, 300)
    got = mixing.mix(df).collect()
    for source in ("a", "b", "c", None):
        rows = sorted((r for r in got if r.source == source), key=lambda r: (r["size"], r.doc_id))
        rate = rows[0].target / rows[0].source_size
        total, upto = 0, [r.copies for r in rows]
        for i, c in enumerate(upto, 1):
            total += c
            assert abs(total - i * rate) <= 1 + 1e-6


def test_odd_rows(spark):
    schema = "doc_id long, source string, text string"
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, None, "x y"), (None, None, "x y"), (2, "b", "q " * 5000)], schema)
    out = mixing.mix(df).collect()
    assert len(out) == 5 and {r["size"] for r in out} == {0, 2, 5000}
    assert sum(r.taken for r in out if r.source == "b") == 5000
    assert mixing.mix(df.limit(0)).count() == mixing.mixed(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.filter("source = 'a'")).collect()} == {0}


def test_reruns_agree_where_ids_repeat(spark):
    """Rows that share source, size and id but not text keep their copies however the rows are dealt; equal rows share theirs."""
    rng = random.Random(4)
    rows = [(1, rng.choice(["a", "b", None]), f"w{i % 40} " * 5, {"k": "v"}) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size map<string,string>")
    counted = lambda d, f: sorted(map(str, f(d).select("source", "text", *(c for c in ("copies",) if f is mixing.mix)).collect()))
    for f in (mixing.mix, mixing.mixed):
        want = counted(df, f)
        assert counted(df.repartition(7, "text"), f) == want
    assert mixing.mixed(df).columns == df.columns and counted(df, mixing.mixed) == sorted(map(str, mixing.emit(mixing.mix(df)).select("source", "text").collect()))


def test_many_sources_need_no_task_of_their_own(spark):
    sizes = {f"s{i:04d}": (i * 7919) % 1000 for i in range(1500)}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_a_hot_source_spreads_over_tasks(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'a' AS source", "repeat('w ', int(id % 50)) AS text")
    placed = mixing.sorted_tasks(df, [F.col("source"), F.col("doc_id")], "hot").groupBy("task").count().collect()
    assert len(placed) > 1 and max(r["count"] for r in placed) < 2500 and mixing.copies(df).count() == 4000


def test_plan_has_no_python(spark):
    _, df = corpus(spark, 50)
    for out in (mixing.copies(df), mixing.mix(df), mixing.mixed(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
