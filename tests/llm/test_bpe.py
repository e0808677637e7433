import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from weftline.llm import bpe, token_histogram
from weftline.llm.queries import VOCABULARY, tokenizer

RANKS, PATTERN = tokenizer()


def reference(raw=RANKS, pattern=PATTERN):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    return ranks, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", [VOCABULARY, "byte_bpe_50k.tiktoken"])
def test_ids_equal_the_library(name):
    raw = bpe.read_ranks(public_tokenizers.path(name))
    ranks, library = reference(raw)
    rng = random.Random(8)
    tokens = list(ranks)
    texts = [None, "", " ", "\n\n a", "it's  we'LL", "aaaaaaaaaaaa", "naïve café — 日本語 🙂🙂", "<|endoftext|>", "x" * 3000]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 20))).decode("utf-8", "replace") for _ in range(1500)]
    texts += ["".join(rng.choice("aeinrst ") for _ in range(200)) for _ in range(200)]
    c = bpe.Codec(raw, PATTERN)
    for text, (ids, listed) in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert listed.decode() == ",".join(map(str, ids.tolist())) and c.decode(ids) == (text or "").encode()


def test_ranks_that_fall_along_a_word():
    """Merging c d at rank 300 makes a pair of rank 299, which comes before the word's next c d."""
    tokens = [bytes([i]) for i in range(256)] + [b"xcd", b"bx"]
    extra = {b"bcd": 299, b"cd": 300, b"dc": 301, b"cdcd": 298, b"aa": 302, b"aaa": 303, b"aaaa": 290}
    raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in [*enumerate(tokens), *((i, t) for t, i in extra.items())])
    _, library = reference(raw, r"\S+|\s+")
    c = bpe.Codec(raw, r"\S+|\s+")
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 14))) for _ in range(3000)] + ["a" * i for i in range(1, 12)]
    assert [ids.tolist() for ids, _ in c.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_small_cache_changes_nothing(monkeypatch):
    _, library = reference()
    monkeypatch.setattr(bpe, "CACHE_CHARS", 60)
    c, rng = bpe.Codec(RANKS, PATTERN), random.Random(3)
    for _ in range(40):
        texts = [" ".join(rng.choice(["one", "deux", "trois", f"w{rng.random()}"]) for _ in range(6)) for _ in range(3)]
        assert [ids.tolist() for ids, _ in c.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert c.count_ids(texts) == [len(library.encode_ordinary(t)) for t in texts]


def test_rows(spark, monkeypatch):
    _, library = reference()
    texts = ["Hello, world", "Hello, world", None, "", "été " * 20_000]
    df = spark.createDataFrame([(i % 4, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i % 4, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in enumerate(texts))
    out = bpe.digests(df, RANKS, PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, out.collect())) == want
    assert bpe.digests(df.limit(0), RANKS, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(df.select("doc_id", "text"), RANKS, PATTERN), RANKS, PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for t in texts)


def test_long_texts_are_split_as_they_are_read(spark, monkeypatch):
    """A text of over two million characters, one match of 100,000 characters, and small blocks."""
    _, library = reference()
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(2, 12))) for _ in range(30_000)]
    texts = [" ".join(rng.choice(words) for _ in range(330_000)), "x" * 100_000, "ab " * 10]
    assert len(texts[0]) > 2 * bpe.BLOCK_CHARS
    c = bpe.Codec(RANKS, PATTERN)
    for t in texts[::2]:
        ((ids, listed),) = c.encode([t])
        assert ids.tolist() == library.encode_ordinary(t) and c.decode(ids) == t.encode() and c.count_ids([t]) == [len(ids)]
        assert listed == ",".join(map(str, ids.tolist())).encode()
    ((ids, _),) = c.encode([texts[1]])
    assert c.decode(ids) == texts[1].encode() and ids.tolist() == library.encode_ordinary(texts[1])
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, *words[:50]])], "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, bpe.digests(df, RANKS, PATTERN).collect()))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1000)
    parts = [ids.tolist() for part in ([t] for t in words[:50]) for ids, _ in c.encode(part)]
    assert parts == [library.encode_ordinary(t) for t in words[:50]] and want[0][1] == len(library.encode_ordinary(texts[0]))


def test_histogram_answers_every_limit(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 5, 1023, 1024, 1025, 5000, rng.randrange(9000)]) for _ in range(400)] + [None]
    hist = token_histogram.histogram(spark.createDataFrame([(n,) for n in sizes], "n_tokens long"))
    sums = token_histogram.suffix_sums(hist)
    plain = [n or 0 for n in sizes]
    rows = sums.collect()
    assert {r.n_tokens for r in rows} == set(plain)
    for r in rows:
        c = r.n_tokens
        assert (r.n_docs, r.tokens) == (plain.count(c), plain.count(c) * c)
        assert (r.docs_longer, r.tokens_longer) == (sum(n > c for n in plain), sum(n for n in plain if n > c))
        assert (r.tokens_kept, r.tokens_lost) == (sum(min(n, c) for n in plain), sum(max(n - c, 0) for n in plain))
        assert r.docs_upto == sum(n <= c for n in plain) and r.quantile == pytest.approx(r.docs_upto / len(plain))
    limits = [0, 1, 3, 1024, 4999, 10**6]
    got = {r.context: r for r in token_histogram.at_limits(sums, spark.createDataFrame([(c,) for c in limits], "context long")).collect()}
    for c in limits:
        assert got[c].tokens_kept == sum(min(n, c) for n in plain) and got[c].docs_longer == sum(n > c for n in plain)
    assert token_histogram.suffix_sums(hist.limit(0)).count() == 0
