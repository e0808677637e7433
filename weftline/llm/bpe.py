"""Byte-level BPE by replaying merges over a corpus of words.

Texts split into words by the tokenizer's pattern, and words merge independently, so a
task encodes its documents block by block: the block's words that it has not met yet
form one corpus of byte tokens with links between neighbours. An inverted index from a
pair's rank to the positions where it stands applies every merge in rank order to all
words at once, and a merge touches only the two pairs beside it. A document is then
the concatenation of its words' ids. Words stay in a cache of bounded characters.

Ranks need not grow along a word: where a merge makes a pair of lower rank, that rank
is replayed next and the rest of the current one after it, as a single word would do.

Null is the empty text: no ids. Any row gives one row; null and repeated ids and further
columns of the rows are carried, columns named like an added one are replaced, and an empty
table gives an empty table. A text of over BLOCK_CHARS is split and learned by REPLAY_WORDS
words at a time; its ids are held whole, and so is a single match of the pattern, whose
replay takes some hundred bytes for each of its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.workers import trimmed

#: Characters of text in a block, and of distinct words that a task keeps.
BLOCK_CHARS, CACHE_CHARS = 1_000_000, 3_000_000
#: Words that are replayed at once, and spans that are gathered at once.
REPLAY_WORDS, SPAN = 15_000, 50_000


def read_ranks(path: str) -> bytes:
    """A rank file as it is: a base64 token and its rank on each line. The vocabulary bounds its size."""
    with open(path, "rb") as f:
        return f.read()


def _pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the token that two tokens make, by first << 20 | second, for all that make one: the vocabulary bounds them."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            first, second = ranks.get(token[:i]), ranks.get(token[i:])
            if first is not None and second is not None:
                out[first << 20 | second] = rank
    return out


class Codec:
    """Encodes and decodes by a rank file's tokens and a pattern that splits texts."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        top = max(self.tokens) + 1
        self.width = np.array([len(self.tokens.get(i, b"")) for i in range(top)], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8)
        self.start = np.cumsum(self.width) - self.width
        self.byte_rank = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.two = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.pairs = _pairs(self.ranks)
        self.decimal = [b"%d," % i for i in range(top)]
        self.digits = np.array([len(x) for x in self.decimal], np.int64)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        #: Of each word: whether a later block met it, its ids, and these in decimal with a comma after each.
        self.again, self.chars = np.zeros(0, bool), 0
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.text, self.text_first, self.text_count = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in sequence, and how many each has. No word is empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        n = len(data)
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        before[ends - sizes] = -1
        after[ends - 1] = -1
        pair = np.full(n, -1)
        pair[:-1] = self.two[data[:-1], data[1:]]
        pair[ends - 1] = -1
        some = np.flatnonzero(pair >= 0)
        some = some[np.argsort(pair[some], kind="stable")]
        heap, cut = np.unique(pair[some], return_index=True)
        # For each rank, the positions where its pair stands or stood; None if the rank is not on the heap.
        index: list[list[int] | None] = [None] * len(self.width)
        heap = heap.tolist()
        for rank, at in zip(heap, np.split(some, cut[1:]), strict=False):
            index[rank] = at.tolist()
        token, before, after, pair = self.byte_rank[data].tolist(), before.tolist(), after.tolist(), pair.tolist()
        known = self.pairs.get
        while heap:
            rank = heappop(heap)
            at, index[rank] = index[rank], None
            at.sort()
            high = rank << 20
            for p in at:
                if pair[p] != rank:
                    continue
                q = after[p]
                right, left = after[q], before[p]
                token[p], token[q], pair[q], after[p], lower = rank, -1, -1, right, False
                if right >= 0:
                    before[right] = p
                    pair[p] = new = known(high | token[right], -1)
                    if new >= 0:
                        if index[new] is None:
                            index[new] = [p]
                            heappush(heap, new)
                        else:
                            index[new].append(p)
                        lower = new < rank
                else:
                    pair[p] = -1
                if left >= 0:
                    pair[left] = new = known(token[left] << 20 | rank, -1)
                    if new >= 0:
                        if index[new] is None:
                            index[new] = [left]
                            heappush(heap, new)
                        else:
                            index[new].append(left)
                        lower = lower or new < rank
                if lower:
                    if index[rank] is None:
                        heappush(heap, rank)
                    index[rank] = [x for x in at if x > p]
                    break
        left = np.array(token)
        alive = left >= 0
        return left[alive].astype(np.int32), np.add.reduceat(alive.astype(np.int64), ends - sizes)

    def places(self, words: list[str]) -> np.ndarray:
        """Each word's place in the cache. Words that are not there are learned; when the cache is full, words that no later block met are forgotten."""
        if self.chars > CACHE_CHARS:
            self.forget()
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        self.again[at[at >= 0]] = True
        if missing:
            new = list({words[i] for i in missing})
            for i in range(0, len(new), REPLAY_WORDS):
                self._add(new[i : i + REPLAY_WORDS])
            at[missing] = np.fromiter((self.words[words[i]] for i in missing), np.int64, len(missing))
        return at

    def _add(self, new: list[str]) -> None:
        ids, count = self.replay([w.encode() for w in new])
        text = np.frombuffer(b"".join(map(self.decimal.__getitem__, ids.tolist())), np.uint8)
        text_count = np.add.reduceat(self.digits[ids], np.cumsum(count) - count)
        self._append(new, np.zeros(len(new), bool), ids, count, text, text_count)

    def _append(self, names: list[str], again: np.ndarray, ids: np.ndarray, count: np.ndarray, text: np.ndarray, text_count: np.ndarray) -> None:
        self.words.update(zip(names, range(len(self.words), len(self.words) + len(names)), strict=True))
        self.first = np.concatenate([self.first, np.cumsum(count) - count + len(self.ids)])
        self.text_first = np.concatenate([self.text_first, np.cumsum(text_count) - text_count + len(self.text)])
        self.again, self.ids, self.text = np.concatenate([self.again, again]), np.concatenate([self.ids, ids]), np.concatenate([self.text, text])
        self.count, self.text_count = np.concatenate([self.count, count.astype(np.int32)]), np.concatenate([self.text_count, text_count.astype(np.int32)])
        self.chars += sum(map(len, names))

    def forget(self) -> None:
        names = [w for w, i in self.words.items() if self.again[i]]
        if 2 * sum(map(len, names)) > CACHE_CHARS:
            names = []
        at = np.fromiter(map(self.words.__getitem__, names), np.int64, len(names))
        kept = self._spans(self.ids, self.first, self.count, at), self.count[at], self._spans(self.text, self.text_first, self.text_count, at), self.text_count[at]
        self.clear()
        self._append(names, np.zeros(len(names), bool), *kept)

    def _encoded(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and these in decimal with a comma after each."""
        return self._spans(self.ids, self.first, self.count, at), self._spans(self.text, self.text_first, self.text_count, at)

    def _pieces(self, text: str) -> Iterator[np.ndarray]:
        """Places of the words of a long text, some at a time; each part is used before the next."""
        found = self.pattern.finditer(text)
        while words := [m.group() for m in islice(found, REPLAY_WORDS)]:
            yield self.places(words)

    def _split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of all texts in sequence, and where each text ends among them."""
        split = [self.split(t or "") for t in texts]
        return self.places(list(chain.from_iterable(split))), np.cumsum([len(words) for words in split])

    def encode_block(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in sequence, and these in decimal, a comma after each; and where each text ends in either."""
        if len(texts) == 1 and len(texts[0] or "") > BLOCK_CHARS:
            ids, text = (np.concatenate(x) for x in zip(*map(self._encoded, self._pieces(texts[0])), strict=True))
            return ids, text, np.array([len(ids)]), np.array([len(text)])
        at, ends = self._split(texts)
        upto = lambda count: np.concatenate([[0], np.cumsum(count[at], dtype=np.int64)])[ends]
        return *self._encoded(at), upto(self.count), upto(self.text_count)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """The ids of each text, and these in decimal with commas between."""
        ids, text, ends, text_ends = self.encode_block(texts)
        i = j = 0
        for end, text_end in zip(ends.tolist(), text_ends.tolist(), strict=True):
            yield ids[i:end], text[j : max(j, text_end - 1)].tobytes()
            i, j = end, text_end

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text: how many ids it has, and SHA-256 of these in decimal and of the bytes that they decode to."""
        ids, text, ends, text_ends = self.encode_block(texts)
        data = self.decode(ids)
        data_ends = np.concatenate([[0], np.cumsum(self.width[ids])])[ends]
        sha, out, i, j, k, raw, plain = lambda x: hashlib.sha256(x).hexdigest(), [], 0, 0, 0, memoryview(data), memoryview(text)
        for end, text_end, data_end in zip(ends.tolist(), text_ends.tolist(), data_ends.tolist(), strict=True):
            out.append((end - i, sha(plain[j : max(j, text_end - 1)]), sha(raw[k:data_end])))
            i, j, k = end, text_end, data_end
        return out

    def count_ids(self, texts: list[str | None]) -> list[int]:
        if len(texts) == 1 and len(texts[0] or "") > BLOCK_CHARS:
            return [sum(int(self.count[at].sum(dtype=np.int64)) for at in self._pieces(texts[0]))]
        at, ends = self._split(texts)
        return np.diff(np.concatenate([[0], np.cumsum(self.count[at], dtype=np.int64)])[ends], prepend=0).tolist()

    @staticmethod
    def _spans(data: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What data has for each of ``at``, one after the other."""
        parts = []
        for i in range(0, len(at), SPAN) or (0,):
            part = at[i : i + SPAN]
            n = count[part].astype(np.int64)
            ends = np.cumsum(n)
            parts.append(data[np.repeat(first[part] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self._spans(self.bytes, self.start, self.width, ids).tobytes()


_codecs: dict[tuple[int, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """The worker's codec for these ranks; a reused worker keeps it and its words."""
    key = hash(ranks), pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches of about BLOCK_CHARS, one text at least."""
    for batch in batches:
        start, held, texts = 0, 0, []
        for i, x in enumerate(batch.column(text)):
            value = x.as_py()
            if texts and held + len(value or "") > BLOCK_CHARS:
                yield batch.slice(start, i - start), texts
                start, held, texts = i, 0, []
            texts.append(value)
            held += len(value or "")
        if texts:
            yield batch.slice(start), texts


def _added(df: DataFrame, added: str, make, text: str) -> DataFrame:
    new = T._parse_datatype_string(added)
    rest = [f for f in df.schema.fields if f.name not in new.names]
    keep, names = [f.name for f in rest if f.name != text], [f.name for f in rest if f.name != text] + new.names
    schema = T.StructType([*(f for f in rest if f.name != text), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *make(texts)], names=names)

    return df.mapInArrow(trimmed(run), schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) in place of its text."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    return _added(df, "ids array<int>", lambda texts: [pa.array([ids for ids, _ in codec(shared.value, pattern).encode(texts)], pa.list_(pa.int32()))], text)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary) in place of its ids; null ids decode to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    rest = [f for f in df.schema.fields if f.name not in (ids, "decoded")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [codec(shared.value, pattern).decode(np.array(x.as_py() or [], np.int64)) for x in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return df.mapInArrow(trimmed(run), T.StructType([*rest, T.StructField("decoded", T.BinaryType())]))


def digests(df: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 in place of its text: encodes, then decodes the ids."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def make(texts: list[str | None]) -> list[pa.Array]:
        rows = codec(shared.value, pattern).digests(texts)
        return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]

    return _added(df, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, text)


def lengths(df: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with n_tokens in place of its text."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    return _added(df, "n_tokens long", lambda texts: [pa.array(codec(shared.value, pattern).count_ids(texts), pa.int64())], text)
