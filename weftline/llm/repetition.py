"""Quality rules from suffix arrays: how much of a text repeats itself.

Words are runs of ``[^\\x20\\x09-\\x0D]``. The words of a block of texts become one
sequence of symbols in which a word has another symbol in each text and each text
ends with a symbol of its own, so one suffix array serves the whole block and no
match leaves a text. Prefix doubling sorts only suffixes that still have an equal.
Longest common prefixes of neighbours are read off the symbols, for each suffix whose
prefix doesn't follow from that of the suffix one word to its left.

A maximal repeat is an LCP interval; the spans of all intervals of at least
``min_words`` words have the same union as, over all suffixes, the longest prefix
that each shares with a neighbour. That union over the text's words is the covered
fraction; the longest prefix is the longest repeat.

A text is judged whole. Its words become 4-byte numbers piece by piece, and all arrays grow with their number only: 20
million words take under 1.5 GB, whatever repeats in them.

Null and empty texts have no words, so they fail the base rule; an empty table gives an empty table. Rows are judged one
by one: repeated rows and ids, null ids and further columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.workers import trimmed

#: A shorter repeat than this is chance or idiom.
MIN_WORDS = 10
#: Verdict: at most this part of the words in repeats, and no repeat longer than this.
MAX_COVERED = 0.3
MAX_REPEAT = 50
#: Words that share a suffix array; a longer text has one of its own.
BLOCK_WORDS = 100_000
#: Bytes of a text that are words at once.
PIECE = 1 << 20
#: Symbols of two suffixes that are compared for all suffixes together; the few that share more are compared one by one.
_STEPS = 64

_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, covered_words long, base_failed boolean, kept boolean"
ADDED = tuple(c.split()[0] for c in COLUMNS.split(", "))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order. The last symbol of each text must occur once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    sorted_ = symbols[order]
    first = np.empty(n, bool)
    first[:1] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=first[1:])
    at = np.arange(n, dtype=np.int32)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))
    step = 1
    while True:
        single = first & np.append(first[1:], True)
        at, first = at[~single], first[~single]
        if not len(at):
            return order
        suffix = order[at]
        key = rank[suffix] * np.int64(n) + rank[suffix + step]
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        del by
        first = np.empty(len(at), bool)
        first[:1] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        del key
        order[at] = suffix
        rank[suffix] = at[np.maximum.accumulate(np.where(first, np.arange(len(at), dtype=np.int32), 0))]
        step *= 2


def _longer(symbols: np.ndarray, i: int, j: int, length: int) -> int:
    """How many symbols two suffixes share, of which ``length`` are known to be shared; read in growing pieces."""
    piece = 2 * _STEPS
    while True:
        a, b = symbols[i + length : i + length + piece], symbols[j + length : j + length + piece]
        n = min(len(a), len(b))
        differs = a[:n] != b[:n]
        if differs.any():
            return length + int(differs.argmax())
        length, piece = length + n, 2 * piece


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Symbols that each suffix shares with the next one in order.

    Where a suffix and the one before it in order stand behind equal symbols, they share one symbol less than
    the suffixes one place to the left. Only the others are compared, and what these share adds up to n log n at most.
    """
    n = len(order)
    before = np.zeros(n, np.int32)
    before[order[1:]] = order[:-1]
    compared = symbols[np.arange(-1, n - 1)] != symbols[before - 1]
    compared[before == 0] = True
    compared[:1] = compared[order[:1]] = True
    i = np.flatnonzero(compared).astype(np.int32)
    i = i[i != order[0]]
    shared = np.zeros(n, np.int32)
    left, right, at = i.copy(), before[i], i
    for _ in range(_STEPS):
        equal = symbols[left] == symbols[right]
        left, right, at = left[equal] + 1, right[equal] + 1, at[equal]
        if not len(at):
            break
        shared[at] += 1
    for k in at.tolist():
        shared[k] = _longer(symbols, k, int(before[k]), int(shared[k]))
    place = np.arange(n, dtype=np.int32)
    shared += place
    last = np.maximum.accumulate(np.where(compared, place, 0))
    return (shared[last] - place)[order[1:]]


def maximal_repeats(words: list, min_words: int = MIN_WORDS) -> list[tuple[int, list[int]]]:
    """(length, starts) of every LCP interval of one text that more words to the left would not keep whole."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    symbols = np.array([*(ids[w] for w in words), len(ids)], np.int64)
    order = suffix_array(symbols)
    lcp, found, open_ = [*common_prefixes(symbols, order).tolist(), 0], [], []
    for i, height in enumerate(lcp):
        start = i
        while open_ and open_[-1][0] > height:
            length, start = open_.pop()
            at = sorted(order[start : i + 1].tolist())
            if length >= min_words and len({words[p - 1] if p else None for p in at}) + (at[0] == 0) > 1:
                found.append((length, at))
        if height and (not open_ or open_[-1][0] < height):
            open_.append((height, start))
    return sorted(found, key=lambda x: (-x[0], x[1]))


def _spanned(end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions before the furthest end so far, counted by text."""
    inside = np.maximum.accumulate(end) > np.arange(len(end))
    return np.add.reduceat(inside.astype(np.int64), starts)


def _block(texts: list[np.ndarray], min_words: int) -> np.ndarray:
    """For each text, given as its words' numbers: words in repeated 3-word windows, longest repeat, words in repeats of min_words."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    n, width = int(sizes.sum()), int(max((t.max(initial=-1) for t in texts), default=-1)) + 2
    end = np.array([width - 1], np.int32)
    symbols = np.concatenate([x for t in texts for x in (t, end)])
    if len(texts) > 1:
        symbols = symbols + np.repeat(np.arange(len(texts), dtype=np.int64) * width, sizes)
    order = suffix_array(symbols)
    lcp = common_prefixes(symbols, order)
    repeat = np.zeros(n, np.int32)
    repeat[order[1:]] = lcp
    repeat[order[:-1]] = np.maximum(repeat[order[:-1]], lcp)
    del order, lcp, symbols
    at = np.arange(n, dtype=np.int32)
    return np.stack([
        _spanned(np.where(repeat >= 3, at + 3, 0), starts),
        np.maximum.reduceat(repeat, starts),
        _spanned(np.where(repeat >= min_words, at + repeat, 0), starts),
    ])


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of some PIECE bytes that end at white space, so that the words of one piece only are objects at a time."""
    at = 0
    while at < len(raw):
        space = _SPACE.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        end = space.start() if space else len(raw)
        yield raw[at:end] if end - at < len(raw) else raw
        at = end


def measure(texts: Iterable[str | None], min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat, covered_words of each text."""
    base, split, held, ids = [], [], 0, {}

    def flush():
        for b, r in zip(base, _block(split, min_words).T.tolist(), strict=True):
            yield (*b, *r)

    for text in texts:
        raw = (text or "").encode()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        parts = []
        for piece in _pieces(raw):
            words = piece.split()
            parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
        own = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        if split and held + len(own) > BLOCK_WORDS:
            yield from flush()
            base, split, held = [], [], 0
        n_lines = len(lines) - len(set(lines))
        base.append((len(own), len(text or "") - len(raw) + len(raw.translate(None, _SPACES)), len(raw) - len(raw.translate(None, _SYMBOLS)), n_lines))
        split.append(own)
        held += len(own) + 1
        if len(ids) > BLOCK_WORDS:  # numbers need only agree within a block
            yield from flush()
            base, split, held, ids = [], [], 0, {}
    if split:
        yield from flush()


def judge(df: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, drop_text: bool = False) -> DataFrame:
    """``df`` with COLUMNS, without its text if told so; columns of these names are replaced. base_failed: under 50 words, or over half the words in repeated 3-word windows."""
    from pyspark.sql import types as T

    added = T._parse_datatype_string(COLUMNS)
    rest = [f for f in df.schema.fields if f.name not in added.names and not (drop_text and f.name == text)]
    schema = T.StructType([*rest, *added.fields])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = list(measure((x.as_py() for x in batch.column(text)), min_words))
            failed = [s[0] < 50 or 100 * s[4] > 50 * s[0] for s in stats]
            kept = [not f and s[5] <= max_repeat and s[6] <= max_covered * s[0] for s, f in zip(stats, failed, strict=True)]
            longs = [pa.array([s[i] for s in stats], pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *longs, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())], names=[*names, *added.names])

    return df.mapInArrow(trimmed(run), schema)
