import pytest
from pyspark.sql import functions as F

from tests.test_graph import EDGE, RELATION, SYMBOL
from weftline.operators import graph, link, skew


@pytest.fixture(params=[(100_000, 2_000), (5, 20), (0, 2_000)])
def limits(request, monkeypatch):
    """No key hot, those of a large part of all rows, and nearly all."""
    monkeypatch.setattr(skew, "LEAST_HOT", request.param[0])
    monkeypatch.setattr(skew, "MOST_HOT", request.param[1])


def sides(spark):
    key = lambda i, m: "hot" if i % 3 == 0 else None if i % 5 == 0 else f"k{i % m}"
    left, right = [(i, key(i, 7)) for i in range(90)], [(i, key(i, 9)) for i in range(60)]
    return left, right, spark.createDataFrame(left, "a long, k string"), spark.createDataFrame(right, "b long, k string")


def test_joins_equal_plain_ones(spark, limits):
    left, right, a, b = sides(spark)
    got = skew.join(a, b, "k", ["a"], skew.hot_keys(a, "k"), skew.hot_keys(b, "k"), ["b"])
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((i, j) for i, x in left for j, y in right if x and x == y)
    one = skew.join(a, b, "k", ["a"], skew.hot_keys(a, "k"))
    assert sorted((r.a, r.b) for r in one.collect()) == sorted((r.a, r.b) for r in got.collect())
    have = {y for _, y in right}
    for how, want in (("left_semi", [i for i, x in left if x and x in have]), ("left_anti", [i for i, x in left if not x or x not in have])):
        assert sorted(r.a for r in skew.join(a, b.select("k").distinct(), "k", ["a"], skew.hot_keys(a, "k"), how=how).collect()) == want
    with pytest.raises(ValueError):
        skew.join(a, b, "k", ["a"], None, skew.hot_keys(b, "k"), ["b"], "left_semi")
    assert skew.join(a.limit(0), b, "k", ["a"], skew.hot_keys(a.limit(0), "k")).count() == 0


def test_a_hot_key_is_shared_by_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 100)
    rows = spark.range(9000).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, "String").otherwise(F.col("id").cast("string")).alias("k"))
    hot = skew.hot_keys(rows, "k")
    assert [(r.k, r._tasks) for r in hot.collect()] == [("String", 30)]
    parts = [r["count"] for r in skew._dealt(rows, hot, "k", "_l", ["a"]).filter("k = 'String'").groupBy("_l").count().collect()]
    assert len(parts) == 30 and max(parts) < 2 * 100


def test_hot_names_and_hubs_give_the_same_graph(spark, limits):
    symbols = [(f"s{i}", "String" if i % 3 == 0 else f"N{i % 8}", f"p{i % 2}", "f.go", 1, 2) for i in range(24)]
    relations = [(f"s{i % 24}", i, "String" if i % 3 else f"x.N{i % 11}", "calls", "h", 0.5) for i in range(60)]
    edges, missing = link.link(spark.createDataFrame(relations, RELATION), spark.createDataFrame(symbols, SYMBOL))
    by = {}
    for s, n, p, *_ in symbols:
        by.setdefault(n, set()).add(s)
    want = {(f, t) for f, _, target, *_ in relations for t in by.get(target.split(".")[-1], ())}
    assert {(r.from_id, r.to_id) for r in edges.collect()} == want
    assert missing.count() == sum(target.split(".")[-1] not in by for _, _, target, *_ in relations)


def test_traversal_equals_brute_force(spark, limits):
    """A hub with a third of the edges, a cycle, a loop, and rounds whose finds raise the scores of nodes found before."""
    pairs = [("hub", f"n{i}", 0.3 + i % 7 / 10) for i in range(20)] + [(f"n{i}", f"n{(i * 3 + 1) % 20}", 0.95) for i in range(20)] + [(f"n{i}", f"m{i}", 0.9) for i in range(20)] + [("n1", "n1", 0.9), ("m3", "far", 0.8)]
    edges = spark.createDataFrame([(a, b, "calls", "h", c) for a, b, c in pairs], EDGE)
    near = {}
    for a, b, c in pairs:
        for u, v in ((a, b), (b, a)):
            near.setdefault(u, {})[v] = max(c, near.get(u, {}).get(v, 0))
    for hops in (0, 1, 2, 3, 4):
        depth, score = {"m3": 0, "n5": 0}, {"m3": 1.0, "n5": 1.0}
        for d in range(1, hops + 1):
            front = [(u, score[u]) for u in depth if depth[u] == d - 1]
            for u, s in front:
                for v, w in near.get(u, {}).items():
                    depth.setdefault(v, d)
                    score[v] = max(score.get(v, 0), s * w)
        nodes, inner = graph.expand(edges, spark.createDataFrame([("m3",), ("n5",)], "id string"), hops)
        assert {r.id: (r.depth, round(r.score, 9)) for r in nodes.collect()} == {i: (depth[i], round(score[i], 9)) for i in depth}
        close = {i for i in depth if depth[i] < hops}
        assert {(r.from_id, r.to_id) for r in inner.collect()} == {(a, b) for a, b, _ in pairs if a in close or b in close}
    starts = spark.createDataFrame([("q1", "m3"), ("q2", "hub"), ("q2", "m3"), ("q3", "none")], "query_id string, id string")
    alone = {q: {r.id: r.depth for r in graph.distances(edges, starts.filter(F.col("query_id") == q), 3).collect()} for q in ("q1", "q2", "q3")}
    each = {q: {} for q in alone}
    for r in graph.distances_each(edges, starts, 3).collect():
        each[r.query_id][r.id] = r.depth
    assert each == alone
