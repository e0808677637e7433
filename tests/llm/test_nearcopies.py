import random

import pytest

import corpus_pipeline
from weftline.llm import nearcopies, simhash, skew


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def corpus(rng):
    """Bases of 100 to 500 words, with copies that change 1 to 12 % of words, chains of them, and unlike texts."""
    texts = []
    for _ in range(25):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(rng.randrange(100, 500))]
        texts.append(" ".join(base))
        for share in (0.01, 0.02, 0.03, 0.05, 0.12):
            copy = base if share < 0.05 else copy
            copy = [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in copy]
            texts.append(" ".join(copy))
    return texts


def components(texts):
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return label


def test_near_copies_equal_all_pairs():
    texts = corpus(random.Random(5))
    label = list(range(len(texts)))
    for i, j in nearcopies.near_copies(texts):
        assert similarity(texts[i], texts[j]) >= 0.8
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert label == components(texts)


def test_stage_drops_near_copies_beyond_two_bits(spark):
    texts = corpus(random.Random(6))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(components(texts))
    assert len(want) <= len(texts) - 25 and simhash.survivors(df).count() > len(want)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == want


def test_no_links_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "alone"), (4, "two words")], "doc_id long, text string")
    assert nearcopies.links(df).count() == 0
    assert nearcopies.links(df.limit(0)).count() == 0


def test_parts_are_linked_once():
    texts = corpus(random.Random(8))
    parts = [i // 3 for i in range(len(texts))]
    found = nearcopies.near_links([nearcopies.shingles(t) for t in texts], parts)
    assert all(parts[i] != parts[j] and similarity(texts[i], texts[j]) >= 0.8 for i, j in found)
    label = list(parts)
    for i, j in found:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    want = list(parts)
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    assert label == want


@pytest.mark.parametrize("block", [3, 1000])
def test_blocks_and_hot_groups_lose_no_link(spark, monkeypatch, block):
    """Buckets of unlike parts, a large group of near copies, exact copies of one text, in blocks of three and with hot keys split."""
    rng = random.Random(9)
    texts = corpus(rng)[:60]
    base = [f"{rng.choice('xyz')}{rng.randrange(300)}" for _ in range(200)]
    for _ in range(40):  # each some 85 % like the base, and many pairs of them under 80 %
        texts.append(" ".join(f"new{rng.randrange(10**6)}" if rng.random() < 0.016 else w for w in base))
    rows = texts + [texts[0]] * 30
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    if block == 3:
        monkeypatch.setattr(skew, "LEAST_HOT", 10)
        monkeypatch.setattr(skew, "MOST_HOT", 1000)
    prints = [int(x) for x in simhash.fingerprints(texts)]
    root = {r.node: r.root for r in simhash.connected(nearcopies.links(df)).collect()}
    label, want = [root.get(p, p) for p in prints], components(texts)
    groups = lambda x: {frozenset(i for i, y in enumerate(x) if y == z) for z in x}
    assert groups(label) == groups(want) and 1 < len(groups(want)) < 60
