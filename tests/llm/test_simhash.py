import random

import numpy as np
import pytest
import xxhash

from weftline.llm import simhash, skew


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=2):
    ids = list(range(len(prints)))
    find = lambda i: i if ids[i] == i else find(ids[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                ids[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    texts = [None, "", " ", "One", "Two Words", "ÉTÉ été É", *(" ".join(rng.choice(["aa", "Bb", "cé", "d"]) for _ in range(rng.randrange(40))) for _ in range(60))]
    assert [int(x) % 2**64 for x in simhash.fingerprints(texts)] == [brute_fingerprint(t) for t in texts]


def test_long_texts_count_bits_in_parts(monkeypatch):
    text = " ".join(str(i) for i in range(1000))
    want = simhash.fingerprints([text])
    monkeypatch.setattr(simhash, "_SHINGLES", 17)
    assert simhash.fingerprints([text]) == want


@pytest.mark.parametrize("segments", [8, 16, 32])
def test_links_equal_brute_force(spark, segments):
    rng = random.Random(segments)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:20]:
        for _ in range(4):
            prints.append(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.links(df, len(prints), segments)
    assert all(((a % 2**64) ^ (b % 2**64)) for a, b in edges.collect())
    root = {r.node: r.root for r in simhash.connected(edges).collect()}
    groups = lambda labels: {frozenset(i for i, x in enumerate(labels) if x == y) for y in labels}
    assert groups([root.get(p, p) for p in signed]) == groups(brute_components(prints))


def test_every_offset_within_reach_meets_once():
    for m, r in ((2, 2), (4, 2), (8, 1)):
        found = simhash.offsets(m, r)
        both = {o for o in found} | {tuple(-x for x in o) for o in found}
        assert len(both) == 2 * len(found) and all(0 < sum(map(abs, o)) <= r for o in both)


def test_segments_grow_with_the_corpus():
    sizes = [simhash.segments_for(n) for n in (10**3, 10**6, 10**8, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == 8


def test_chains_connect(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {101: 100}
    assert simhash.connected(edges.limit(0)).count() == 0


def test_components_and_survivors(spark):
    base = [f"w{i}" for i in range(400)]
    near = " ".join([*base[:-1], "changed"])
    other = " ".join(f"z{i}" for i in range(300))
    rows = [(7, " ".join(base)), (3, " ".join(base).upper()), (9, near), (4, other), (4, other), (None, other), (5, None), (6, ""), (None, "alone of its kind here")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, fp int")
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    smallest = {x: min((i for (i, _), y in zip(rows, label, strict=True) if y == x and i is not None), default=None) for x in label}
    want = sorted(((i, f"{p:016x}", smallest[x]) for (i, _), p, x in zip(rows, prints, label, strict=True)), key=str)
    assert sorted(map(tuple, simhash.components(df).collect()), key=str) == want
    kept = simhash.survivors(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(({smallest[x] for x in label}), key=str)
    assert kept.count() == len(set(label))
    assert simhash.components(df.limit(0)).count() == 0


def test_hot_stars_and_fingerprints_are_split(spark, monkeypatch):
    rng = random.Random(6)
    hub = [(0, i) for i in range(1, 60)] + [(200, i) for i in range(100, 160)] + [(rng.randrange(60, 90), rng.randrange(60, 90)) for _ in range(25)]
    edges = spark.createDataFrame(hub + [(i, i + 40) for i in (59, 60)], "a long, b long")
    plain = {r.node: r.root for r in simhash.connected(edges).collect()}
    texts = [("same words here again" if i % 3 == 0 else "" if i % 3 == 1 else f"alone {i} of {i * 7} kinds {i * 31}") for i in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = sorted(map(tuple, simhash.components(df).collect()))
    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    monkeypatch.setattr(skew, "MOST_HOT", 20)
    assert {r.node: r.root for r in simhash.connected(edges).collect()} == plain
    assert sorted(map(tuple, simhash.components(df).collect())) == whole
    label = list(range(300))
    for r in edges.collect():
        label = [min(label[r.a], label[r.b]) if x in (label[r.a], label[r.b]) else x for x in label]
    assert plain == {i: x for i, x in enumerate(label) if x != i}


def test_stars_need_no_round(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 5), (1, 7), (2, 6)], "a long, b long")
    monkeypatch.setattr(simhash, "_joined", None)
    assert {r.node: r.root for r in simhash.connected(edges).collect()} == {5: 1, 7: 1, 6: 2}
