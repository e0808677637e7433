"""Line dedup: of each line, the first document that holds it keeps it.

A line's key is its text without white space at both ends, A-Z lower-cased; keys of ``least``
code points or more are compared by 128-bit hashes, shorter lines always stay. One pass over the
texts leaves a narrow row for each document, with its lines' hashes. These are range-partitioned
by (hash, document, position) and sorted so within their tasks, and a task streams them: lines of
the first document of a hash stay, those of later documents go. Because documents and positions
are part of the range, a line that a third of all documents hold spreads over many tasks; a task
whose first hash began in an earlier task learns that hash's first document from a table of two
rows for each task.

The result is not text but, for each document, how many lines it has and loses, and a bitmap of
the lines that it keeps, one bit each from the first line on, compressed. ``applied`` meets texts
with their bitmaps and yields what is left of them.

A document is a doc_id: rows of one id are one document, and none loses a line to another. Null
ids are one document, the last. A bitmap belongs to an id and a text, so rows equal in both share
it. A null or empty text is one empty line. A key of any length is hashed whole; a text's lines
are one row. Rows that many copies of an id and text have (a third of all rows, say) are counted once
before lines are sorted, and where texts meet bitmaps Spark may split them. An empty table gives an
empty table. Further columns are not read by ``bitmaps`` and are kept by ``applied``, but for those named as
in ``ADDED``, which are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.workers import trimmed
from weftline.staging import drop, stage

LEAST_CHARS = 10
SPACES = " \t\n\x0b\x0c\r"
ADDED = ("n_lines", "n_dropped", "keep")
#: Sorted rows of a task, and rows of an Arrow batch of exploded lines.
TASK_ROWS, _BATCH = 4_000_000, 200_000
_OWN = "_weftline_lines_"
#: Kinds of streamed rows: a line that goes; one that goes if its hash began in an earlier task with another document; a task's first and last hash.
_GOES, _OPEN, _FIRST, _LAST = range(4)


def line_keys(text: str | None, least: int = LEAST_CHARS) -> tuple[int, list[int], bytes]:
    """How many lines a text has, the positions of those with a key of ``least`` code points, and the keys' hashes, 16 bytes each."""
    lines = (text or "").split("\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        key = line.strip(SPACES)
        if len(key) >= least:
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes lower A-Z only
    return len(lines), at, b"".join(hashes)


def packed(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpacked(keep: bytes, n_lines: int) -> np.ndarray:
    """The bitmap's ``n_lines`` booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines, bitorder="little").astype(bool)


def _of_text(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _documents(df: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc, t, n_lines, at, hashes): each row's lines. ``t`` tells texts of one id apart."""
    rows = df.select(F.col(doc_id).alias("doc"), _of_text(text).alias("t"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_keys(x.as_py(), least) for x in b.column("text")]
            at = pa.array([np.array(f[1], np.int32).tobytes() for f in found], pa.binary())
            own = [pa.array([f[0] for f in found], pa.int64()), at, pa.array([f[2] for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("t"), *own], names=["doc", "t", "n_lines", "at", "hashes"])

    return rows.mapInArrow(trimmed(run), f"doc {rows.schema['doc'].dataType.simpleString()}, t long, n_lines long, at binary, hashes binary")


def _lines(docs: DataFrame) -> DataFrame:
    """(hi, lo, doc, t, at): a row for each hash of documents."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array([len(x.as_buffer()) // 16 if x.is_valid else 0 for x in b.column("hashes")], np.int64)
            first, total = 0, np.cumsum(sizes)
            while first < len(sizes):  # as many documents as fill a batch, one at least
                upto = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + _BATCH, "right")))
                of = pa.array(np.repeat(np.arange(first, upto), sizes[first:upto]))
                part = [b"".join(b.column(c).slice(first, upto - first).to_pylist()) for c in ("hashes", "at")]
                hash_ = np.frombuffer(part[0], np.int64).reshape(-1, 2)
                columns = [pa.array(hash_[:, 0].copy()), pa.array(hash_[:, 1].copy()), b.column("doc").take(of), b.column("t").take(of), pa.array(np.frombuffer(part[1], np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "doc", "t", "at"])
                first = upto

    return docs.select("doc", "t", "at", "hashes").mapInArrow(trimmed(run), f"hi long, lo long, doc {kind}, t long, at int")


def _differs(column: pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before (``last`` for the first), nulls being equal."""
    if not len(column):
        return np.zeros(0, bool)
    before = pa.concat_arrays([pa.array([None if last is None else last.as_py()], column.type), column.slice(0, len(column) - 1)])
    same = pc.fill_null(pc.equal(column, before), False).to_numpy(zero_copy_only=False)
    both = pc.and_(pc.is_null(column), pc.is_null(before)).to_numpy(zero_copy_only=False)
    out = ~(same | both)
    if last is None:
        out[0] = True
    return out


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted task's decisions. Only the last row, and what is known of its hash, passes from batch to batch."""
    task = TaskContext.get().partitionId()
    names = ["kind", "task", "hi", "lo", "doc", "t", "at"]
    last, in_first, in_open, first_doc, head = None, True, True, None, None

    def rows(kind: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
        own = [pa.array(kind.astype(np.int32)), pa.array(np.full(len(kind), task, np.int32))]
        return pa.RecordBatch.from_arrays([*own, *(b.column(c) for c in names[2:])], names=names)

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        head = b.slice(0, 1) if head is None else head
        old = (lambda c: None) if last is None else (lambda c, last=last: last.column(c)[0])
        new = _differs(b.column("hi"), old("hi")) | _differs(b.column("lo"), old("lo"))
        other = _differs(b.column("doc"), old("doc"))
        again = ~(new | other | _differs(b.column("t"), old("t")) | _differs(b.column("at"), old("at")))  # a repeated row's line
        changes = np.cumsum(other & ~new)
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        since = changes - np.where(start >= 0, changes[start], 0)
        first = (since == 0) & ((start >= 0) | in_first)
        runs = np.cumsum(new) + (0 if last is not None else -1)
        open_ = in_open & (runs == 0)
        if start[-1] >= 0:
            first_doc = b.slice(int(start[-1]), 1)
        in_first, in_open, last = bool(first[-1]), bool(open_[-1]), b.slice(n - 1, 1)
        told = (~first | open_) & ~again
        if told.any():
            which = np.flatnonzero(told)
            yield rows(np.where(first[which], _OPEN, _GOES), b.take(pa.array(which)))
    if head is not None:
        yield rows(np.array([_FIRST]), head)
        yield rows(np.array([_LAST]), first_doc)


def dropped(lines: DataFrame, rows: int) -> DataFrame:
    """(doc, t, at) of the lines that go."""
    order = ["hi", "lo", F.col("doc").asc_nulls_last(), "t", "at"]
    tasks = max(-(-rows // TASK_ROWS), min(lines.sparkSession.sparkContext.defaultParallelism, -(-rows // 10_000)), 1)
    placed = lines.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    kind = lines.schema["doc"].dataType.simpleString()
    told = stage(placed.mapInArrow(trimmed(_streamed), f"kind int, task int, hi long, lo long, doc {kind}, t long, at int"), "told")
    # A row for each task: where a hash that goes on in later tasks began.
    ends = told.filter(F.col("kind") == _LAST).groupBy("hi", "lo").agg(F.min("task").alias("since"), F.min_by(F.struct("doc"), "task").alias("began"))
    went_on = told.filter(F.col("kind") == _FIRST).select("hi", "lo", "task").join(ends, ["hi", "lo"]).filter(F.col("since") < F.col("task"))
    open_ = told.filter(F.col("kind") == _OPEN).join(F.broadcast(went_on.select("task", "began")), "task")
    late = open_.filter(~F.col("doc").eqNullSafe(F.col("began.doc")))
    return told.filter(F.col("kind") == _GOES).select("doc", "t", "at").unionByName(late.select("doc", "t", "at"))


def bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, t, n_lines, n_dropped, keep): a row for each id and text, ``t`` being the text's 64-bit hash."""
    kind = df.schema[doc_id].dataType
    docs = stage(_documents(df, doc_id, text, least), "lines")
    if docs.groupBy("doc", "t").count().filter("count > 1").take(1):  # repeated rows count once
        once, again = docs.groupBy("doc", "t").agg(*(F.first(c).alias(c) for c in ("n_lines", "at", "hashes"))), docs
        docs = stage(once, "once")
        drop(again)
    rows = docs.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    gone = dropped(_lines(docs), rows // 16).groupBy("doc", "t").agg(F.collect_list("at").alias("gone"))  # a text's lines bound a group
    key = lambda c: F.struct(c, "t")
    met = docs.select("doc", "t", "n_lines").withColumn("k", key("doc")).join(gone.select(key("doc").alias("gk"), "gone"), F.col("k").eqNullSafe(F.col("gk")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keeps, counts = [], []
            for n, gone in zip(b.column("n_lines").to_pylist(), b.column("gone"), strict=True):
                keep = np.ones(n, bool)
                if gone.is_valid:
                    keep[gone.values.to_numpy(zero_copy_only=False)] = False
                keeps.append(packed(keep))
                counts.append(n - int(keep.sum()))
            columns = [b.column("doc"), b.column("t"), b.column("n_lines"), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n_lines", "n_dropped", "keep"])

    narrow = met.select("doc", "t", "n_lines", "gone")
    out = stage(narrow.mapInArrow(trimmed(run), f"doc_id {kind.simpleString()}, t long, n_lines long, n_dropped long, keep binary"), "bitmaps")
    drop(docs)
    return out


def kept_text(text: str | None, keep: bytes, n_lines: int) -> str:
    """The lines of a text that its bitmap keeps."""
    flags = unpacked(keep, n_lines)
    return (text or "") if flags.all() else "\n".join(x for x, k in zip((text or "").split("\n"), flags.tolist(), strict=True) if k)


def _met(df: DataFrame, maps: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` beside its rows' bitmaps. Null ids meet by the text alone."""
    own = df.drop(*ADDED).withColumns({_OWN + "none": F.col(doc_id).isNull(), _OWN + "t": _of_text(text)})
    maps = maps.select(F.col("doc_id").alias(_OWN + "doc"), F.col("t").alias(_OWN + "t"), *ADDED, F.col("doc_id").isNull().alias(_OWN + "none"))
    own = own.withColumn(_OWN + "at", F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    maps = maps.withColumn(_OWN + "at", F.coalesce(F.col(_OWN + "doc").cast("string"), F.lit(""))).drop(_OWN + "doc")
    return own.join(maps, [_OWN + "at", _OWN + "none", _OWN + "t"]).drop(_OWN + "at", _OWN + "none", _OWN + "t")


def _with(df: DataFrame, text: str, column: str, kind: pa.DataType, spark_kind: T.DataType, f) -> DataFrame:
    """``df`` with its text replaced by ``column``: f of text, bitmap and number of lines."""
    rest = [x for x in df.schema.fields if x.name not in (text, column)]
    names = [x.name for x in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([f(x.as_py(), k.as_py(), n.as_py()) for x, k, n in zip(b.column(text), b.column("keep"), b.column("n_lines"), strict=True)], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], names=[*names, column])

    return df.mapInArrow(trimmed(run), T.StructType([*rest, T.StructField(column, spark_kind)]))


def applied(df: DataFrame, maps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with its texts cut to the kept lines, and n_lines, n_dropped and keep. Texts move once."""
    return _with(_met(df, maps, doc_id, text), text, text, pa.string(), T.StringType(), kept_text)


def digests(df: DataFrame, maps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, and kept_sha256 of what ``applied`` leaves."""
    from hashlib import sha256

    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = _with(_met(narrow, maps, "doc_id", "text"), "text", "kept_sha256", pa.string(), T.StringType(), lambda x, k, n: sha256(kept_text(x, k, n).encode()).hexdigest())
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLE = r"""
WITH l AS (SELECT r, doc_id, i, line, lower_az AS key FROM (
    SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM (
      SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
  LATERAL (SELECT translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az)),
f AS (SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS first_id FROM l WHERE length(key) >= 10 GROUP BY key),
k AS (SELECT r, l.doc_id, i, line, first_id IS NOT NULL AND coalesce(l.doc_id, 9223372036854775807) <> first_id AS gone FROM l LEFT JOIN f ON l.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY r
"""
