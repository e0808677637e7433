import numpy as np
import pytest

from weftline.llm import ivfpq

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, every, k):
    """Nearest rows of the same dimension, by brute force."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in good if i % every == 0}:
        best = {}
        for own in (v for i, v in good if i == q):
            for i, v in good:
                if i != q and len(v) == len(own):
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - own) ** 2).sum())))
        if best:
            out[q] = sorted(best.items(), key=lambda x: (x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    x = (centres[rng.integers(30, size=3000)] + rng.normal(size=(3000, 32)) * 0.6).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got, want = found(ivfpq.search(df)), exact(rows, 100, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, best in got.items():
        for i, s in best:
            assert s == pytest.approx(float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum())), rel=1e-12)


def test_hot_vector_is_split_and_ties_go_to_small_ids(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "SHARD_ROWS", 16)
    monkeypatch.setattr(ivfpq, "QUERY_ROWS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).astype(np.float32).tolist()) for i in range(600)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got, want = found(ivfpq.search(df, lists=8, probes=8)), exact(rows, 100, 10)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_odd_vectors(spark):
    """Each dimension is searched by itself; no row of two dimensions has a distance to a row of three."""
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (200, None), (300, []), (400, [0.0, 0.0]), (500, [float("nan"), 1.0]), (600, [None, 1.0]), (700, [float("inf"), 1.0]), (800, [1.0, 2.0, 3.0]), (801, [1.0, 2.0, 3.5]), (900, [-0.0, 2.0, 3.0, 4.0]), (5, [1.0, 1.0]), (5, [3.0, 1.0]), (None, [1.0, 0.5]), (100, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = found(ivfpq.search(df))
    want = exact(rows, 100, 10)
    assert {q: [i for i, _ in b] for q, b in got.items()} == {q: [i for i, _ in b] for q, b in want.items()} == {0: [5, 100], 100: [5, 0], 800: [801]}
    assert ivfpq.search(df.limit(0)).count() == 0
    assert ivfpq.search(df.filter("vec_id = 400")).count() == 0
    assert ivfpq.search(df.filter("vec_id = 0")).count() == 0


def test_repeated_ids_count_once_against_the_limits(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "SHARD_ROWS", 16)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    near = np.array(rows[0][1])
    rows += [(1001, (near + 0.01).tolist())] * 150 + [(1002, (near + rng.normal(size=8) * 0.01).tolist()) for _ in range(150)] + [(100, rows[100][1])] * 20
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got, want = found(ivfpq.search(df, lists=2, probes=2)), exact(rows, 100, 10)
    for q in want:
        assert len(got[q]) == 10 and [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_codes_select_what_is_measured(spark, monkeypatch):
    """With vectors of no clusters and every list probed, codes alone choose 100 of 2,000 ids for each query, and recall stays over 0.9."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    seen = []
    ranked = ivfpq._ranked
    monkeypatch.setattr(ivfpq, "_ranked", lambda df, by, order, most: seen.append((order, ranked(df, by, order, most))) or seen[-1][1])
    got, want = found(ivfpq.search(df, lists=40, probes=40)), exact(rows, 100, 10)
    measured = [d for order, d in seen if order == "near"][-1].groupBy("key").count().collect()
    assert len(measured) == 20 and {r["count"] for r in measured} == {ivfpq.RERANK}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_lists_grow_beyond_the_coarse_centroids():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 8))
    q = ivfpq.Quantizer(x, 60, max_coarse=8)
    assert len(q.coarse) == 8 and len(q.fine) == 8
    at = q.lists(x)
    assert len(np.unique(at)) > 40 and at.max() < 64
    distance = ((x[:50, None] - q.centre(np.arange(64))[None]) ** 2).sum(axis=2)
    assert np.allclose(np.take_along_axis(distance, q.probes(x[:50], 64), 1), np.sort(distance, axis=1))
    assert 1 <= q.probes_for(x, 0.9, 10) <= 64


def test_two_level_lists_find_as_well(spark, monkeypatch):
    monkeypatch.setattr(ivfpq, "MAX_COARSE", 4)
    monkeypatch.setattr(ivfpq.Quantizer.__init__, "__defaults__", (ivfpq.PARTS, ivfpq.CODEWORDS, 4))
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(ivfpq.search(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA))), exact(rows, 100, 10)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
