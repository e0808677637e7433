"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint maps to the counts of set bits in equal segments. The Manhattan
distance of two such points is a lower bound of the Hamming distance, so a grid whose
cells are the points themselves, joined with each cell's neighbours within
``max_bits``, yields every link; XOR and popcount then decide exactly.

Only distinct fingerprints take part: copies share one, and are counted with it. Each
fingerprint goes to its own cell and to the neighbours on one side, so a pair meets
once. A task verifies its cells in bounded chunks and returns a spanning forest of the
links found, never all pairs. More segments mean smaller cells and more neighbours;
``segments_for`` takes the cheapest for the number of fingerprints.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. Null and empty texts have
fingerprint 0, linked like any other. A long text's shingles are hashed at once, 8 bytes for
each, and their bits counted in parts. A repeated doc_id keeps one row per input row. A
null doc_id is linked too, and is a component's id only where no member has an id. Of
components of equal smallest ids each is a component; an empty table gives an empty table.
Other columns are not read by ``components``, and are kept by ``survivors``, whatever their names.

Documents meet their fingerprint's component, and the links of a star its centre, through
``skew.attach``: a fingerprint or a centre with a third of the rows is split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm import skew
from weftline.llm.workers import trimmed
from weftline.staging import drop, stage

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Shingles whose bits are unpacked at once, pairs verified at once, and grid rows of a task.
_SHINGLES, _PAIRS, _ROWS = 20_000, 1_000_000, 1_000_000


def _hashes(text: str | None, k: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - k + 1))


def fingerprints(texts, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text as int64: bits set in over half of its shingles' hashes."""
    out = []
    for text in texts:
        h, ones = _hashes(text, k), np.zeros(64, np.int64)
        for i in range(0, len(h), _SHINGLES):
            part = h[i : i + _SHINGLES].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])
    return np.array(out, np.int64)


def with_fingerprint(df: DataFrame, text: str = "text", k: int = SHINGLE_WORDS, column: str = "fp") -> DataFrame:
    """``df`` without its text, with ``column`` (long)."""
    rest = [f for f in df.schema.fields if f.name not in (text, column)]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fingerprints((x.as_py() for x in b.column(text)), k))], names=[*names, column])

    return df.mapInArrow(trimmed(run), T.StructType([*rest, T.StructField(column, T.LongType())]))


def offsets(segments: int, max_bits: int) -> list[tuple[int, ...]]:
    """Vectors of Manhattan length 1 to max_bits whose first non-zero part is positive."""
    found = []

    def grow(vector: list[int], left: int):
        if len(vector) == segments:
            if any(vector) and next(x for x in vector if x) > 0:
                found.append(tuple(vector))
            return
        for step in range(-left, left + 1):
            grow([*vector, step], left - abs(step))

    grow([], max_bits)
    return found


def segments_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Of 8, 16, 32 and 64 segments, those with the fewest rows and pairs among n random fingerprints."""

    def cost(m: int) -> float:
        near = sum(comb(m, i) * comb(max_bits, i) * 2**i for i in range(max_bits + 1))
        width = 64 // m
        return n * near / 2 + n * n / 2 * near * (comb(2 * width, width) / 4**width) ** m

    return min((8, 16, 32, 64), key=cost)


def _cells(fps: DataFrame, segments: int, max_bits: int) -> DataFrame:
    """(cell, fp, home): each fingerprint in its own cell and in those of its neighbours on one side."""
    width = 64 // segments
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask))) for i in range(segments)]
    bits = (width + 2 * max_bits).bit_length()
    per = 63 // bits
    words = [range(i, min(i + per, segments)) for i in range(0, segments, per)]
    code = lambda values, r: reduce(lambda a, b: a + b, (v * (1 << ((i - r[0]) * bits)) for i, v in ((i, values[i]) for i in r)))
    own = [code([(c + max_bits).cast("long") for c in counts], r) for r in words]
    steps = [(0,) * segments, *offsets(segments, max_bits)]
    deltas = F.array(*(F.struct(*(F.lit(code(s, r)).cast("long").alias(f"d{i}") for i, r in enumerate(words)), F.lit(not any(s)).alias("home")) for s in steps))
    moved = fps.select("fp", *(c.alias(f"c{i}") for i, c in enumerate(own)), F.explode(deltas).alias("d"))
    keys = [F.col(f"c{i}") + F.col(f"d.d{i}") for i in range(len(words))]
    return moved.select(keys[0].alias("cell") if len(keys) == 1 else F.xxhash64(*keys).alias("cell"), "fp", F.col("d.home").alias("home"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the links but those smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            rest = label != np.arange(len(nodes))
            return nodes[rest], nodes[label[rest]]
        label = new


def _verify(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((fp, cell, ~home))
    cell, fp = cell[order], fp[order]
    n = int(home.sum())
    homes = cell[:n]
    low, high = np.searchsorted(homes, cell, "left"), np.searchsorted(homes, cell, "right")
    low[:n] = np.arange(1, n + 1)
    pairs = np.maximum(high - low, 0)
    some = np.flatnonzero(pairs)
    found_a, found_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    upto = np.cumsum(pairs[some])
    for k in range(0, int(upto[-1]) if len(upto) else 0, _PAIRS):
        number = np.arange(k, min(k + _PAIRS, upto[-1]))
        which = np.searchsorted(upto, number, "right")
        left = some[which]
        right = low[left] + number - (upto[which] - pairs[left])
        near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= max_bits
        near &= fp[left] != fp[right]
        if near.any():
            found_a, found_b = _forest(np.concatenate([found_a, fp[left][near]]), np.concatenate([found_b, fp[right][near]]))
    return found_a, found_b


def links(fps: DataFrame, n: int, segments: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that connect what all links within max_bits of ``n`` distinct fingerprints ``fp`` connect."""
    segments = segments or segments_for(n, max_bits)
    grid = n * (len(offsets(segments, max_bits)) + 1)
    spark = fps.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches]
        if parts:
            a, b = _verify(*(np.concatenate(x) for x in zip(*parts, strict=True)), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), grid // _ROWS + 1)
    return _cells(fps, segments, max_bits).repartition(tasks, "cell").mapInArrow(trimmed(run), "a long, b long")


def _shape(e: DataFrame) -> tuple[bool, int]:
    """Whether links (u, v), u > v, are stars already: no node has two smaller ones, or a smaller and a larger one; and the most links of a node."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    loose, most = nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)), F.max(F.col("up") + F.col("down"))).first()
    return not loose, most or 0


def _joined(links: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """links with the least neighbour of their u, split where a node has many."""
    if most <= skew.LEAST_HOT:
        return links.join(least, "u")
    return skew.attach(links, least, "u", links.groupBy("u").agg(F.count(F.lit(1)).alias("n")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large and small stars until only stars are left.

    A star's centre meets its neighbours through a partial minimum and a join, not in one group.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    done, most = _shape(e)
    while not done:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _joined(both.filter("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, least, most).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = stage(small.filter("u > v").distinct(), "edges")
        drop(e)
        e = new
        done, most = _shape(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _linked(df: DataFrame, doc_id: str, text: str, k: int, max_bits: int, segments: int | None, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), and each fp's first_id, n rows and root; ``more`` holds further links (a, b) of fingerprints."""
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    rows = stage(with_fingerprint(narrow, "text", k), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    within = links(fps.select("fp"), fps.count(), segments, max_bits)
    found = connected(within if more is None else within.unionByName(more))
    return rows, fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable): one row per row of ``df``."""
    rows, of = _linked(df, doc_id, text, k, max_bits, segments)
    ids = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(of.join(ids, "root").select("fp", "n", "component_id"), "components")
    return skew.attach(rows, named.drop("n"), "fp", named.select("fp", "n")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, more: DataFrame | None = None) -> DataFrame:
    """One row of ``df`` for each component: that of the smallest doc_id (null last), then of the smallest text hash; of rows equal in both, any.

    ``more`` holds links (a, b) of fingerprints beside those within max_bits.
    """
    rows, of = _linked(df, doc_id, text, k, max_bits, None, more)
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"))
    # One key that is never null, so that the join and the removal of repeats share a partitioning of the texts.
    key = lambda id_, hash_: F.concat(F.coalesce(F.concat(F.lit("="), F.col(id_).cast("string")), F.lit("")), F.lit(":"), hash_.cast("string"))
    own = "_weftline_simhash_key"
    keep = least.join(of, "fp").groupBy("root").agg(F.min("row").alias("row")).select(key("row.doc_id", F.col("row.text_hash")).alias(own)).distinct()
    return df.withColumn(own, key(doc_id, F.xxhash64(F.col(text)))).join(keep, own, "left_semi").dropDuplicates([own]).drop(own)
