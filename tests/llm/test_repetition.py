import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from weftline.llm import repetition


def covered(words, k):
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    n, at = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            at.update(range(i, i + k))
    return len(at)


def brute(text, min_words):
    words = (text or "").encode().split()
    longest = 0
    while covered(words, longest + 1):
        longest += 1
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), covered(words, 3), longest, covered(words, min_words)


def test_measures_equal_brute_force():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a", "a\u00a0b é\u2028 é", "x\n\nx\n y\n"]
    texts += ["".join(rng.choice("ab #\n") for _ in range(rng.randrange(120))) for _ in range(300)]
    texts += [" ".join(rng.choice(["un", "deux", "trois", "4"]) for _ in range(rng.randrange(90))) for _ in range(100)]
    assert list(repetition.measure(texts, 4)) == [brute(t, 4) for t in texts]


def test_blocks_do_not_change_measures(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(50)]
    want = list(repetition.measure(texts, 4))
    monkeypatch.setattr(repetition, "BLOCK_WORDS", 7)
    assert list(repetition.measure(texts, 4)) == want


def test_maximal_repeats():
    words = "a b c x a b c y b c z".split()
    assert repetition.maximal_repeats(words, 2) == [(3, [0, 4]), (2, [1, 5, 8])]
    assert repetition.maximal_repeats("a b c d".split(), 1) == []
    union = set()
    for length, starts in repetition.maximal_repeats(words, 2):
        union.update(i for s in starts for i in range(s, s + length))
    assert len(union) == covered(words, 2)


def test_long_text():
    line = " ".join(f"w{i}" for i in range(60))
    (m,) = repetition.measure([(line + "\n") * 2000])
    assert m[0] == 120_000 and m[5] == 120_000 - 60 and m[6] == 120_000 and m[3] == 1999


def test_verdicts_and_rows(spark):
    prose = " ".join(f"w{i}" for i in range(200))
    echo = prose + " " + " ".join(f"w{i}" for i in range(60))
    schema = "doc_id long, text string, kept string, n_words string"
    rows = [(1, prose, "x", "x"), (1, prose, "x", "x"), (None, prose, None, None), (2, echo, "x", "x"), (3, None, "x", "x"), (4, "", "x", "x"), (5, "short text", "x", "x"), (6, "a b c " * 40, "x", "x")]
    df = spark.createDataFrame(rows, schema)
    got = repetition.judge(df)
    assert got.columns == ["doc_id", "text", *[c.split()[0] for c in repetition.COLUMNS.split(", ")]]
    judged = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in got.collect())
    assert judged == [(0, False, True), (1, False, True), (1, False, True), (2, False, False), (3, True, False), (4, True, False), (5, True, False), (6, True, False)]
    assert repetition.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "kept"), [(50, True), (51, False)])
def test_longest_repeat_limit(n, kept):
    text = " ".join([*(f"w{i}" for i in range(n)), *(f"x{i}" for i in range(300)), *(f"w{i}" for i in range(n))])
    (m,) = repetition.measure([text])
    assert m[5] == n and (m[5] <= repetition.MAX_REPEAT and m[6] <= repetition.MAX_COVERED * m[0]) is kept


@pytest.mark.parametrize("words", [["a", "b"], [f"word{i}" for i in range(999)], None])
def test_memory_grows_with_the_words_alone(words):
    """Two million words, whatever repeats in them, take a tenth of what the docstring says of twenty million."""
    n = 2_000_000
    rng = random.Random(3)
    text = " ".join(words[i % len(words)] if words else f"w{rng.randrange(5000)}" for i in range(n))
    tracemalloc.start()
    try:
        (m,) = repetition.measure([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert m[0] == n and (m[5] == n - len(words) and m[6] == n if words else m[5] < 10)
    assert peak < 150_000_000


def test_prefixes_of_any_length_equal_brute_force():
    """Repeats around the number of symbols that are compared together, and of several lengths at once."""
    rng = random.Random(9)
    for length in (1, 62, 63, 64, 65, 66, 200, 700):
        part = [rng.randrange(3) for _ in range(length)]
        symbols = np.array([*part, 5, *part, 6, *part[length // 2 :], 7, *part, 8], np.int32)
        order = repetition.suffix_array(symbols)
        rest = symbols.tolist()
        assert order.tolist() == sorted(range(len(rest)), key=lambda i: rest[i:])
        want = [next(k for k, (x, y) in enumerate(zip(rest[a:], rest[b:], strict=False)) if x != y) for a, b in zip(order[:-1], order[1:], strict=True)]
        assert repetition.common_prefixes(symbols, order).tolist() == want
