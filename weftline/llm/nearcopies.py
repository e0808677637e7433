"""Links between near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash bands say which texts may be near copies, and exact similarities which are, so a
link is never a guess. With ROWS minima in each of BANDS bands, a pair of similarity s meets
in a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9994 at 0.8, and more above. Texts
that share a band are a bucket, and texts that buckets connect a cluster. All texts of a
cluster of up to BLOCK meet in a task, through an index from shingle to texts.

In a larger cluster every text is first measured against one other, the least of the bucket
that it shares with it most often, so a large group of copies becomes a few parts without
being compared. Only buckets that still hold several parts go on: their texts are compared
BLOCK with BLOCK, a task for each two blocks, and only texts of different parts. So no
bucket, cluster or group of copies of any size meets in one task, and no pair that shares a
bucket is left out.

Equal texts are one text. Null and empty texts have no shingles and no links. A long text is
hashed at once, 8 bytes for each of its words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.simhash import _hashes, connected, fingerprints, with_fingerprint
from weftline.llm.skew import attach
from weftline.llm.workers import trimmed
from weftline.staging import stage

SHINGLE_WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 8, 40
#: Texts of a larger cluster that are compared with as many others in a task.
BLOCK = 1000
#: Shingles whose minima are taken at once.
_PART = 512
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(text: str | None) -> np.ndarray:
    """The text's band keys (none for a text without words)."""
    h = _hashes(text, SHINGLE_WORDS)
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), _PART):
        np.minimum(least, (h[i : i + _PART, None] * _FACTORS).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def shingles(text: str | None) -> np.ndarray:
    return np.unique(_hashes(text, SHINGLE_WORDS)).view(np.int64)


def near_links(sets: list[np.ndarray], parts: list[int], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Positions of linked sets of different parts: they connect what all such pairs of the similarity connect.

    A part that is reached is compared with those not reached yet, through an index from shingle to sets.
    """
    _, part = np.unique(parts, return_inverse=True)
    order = np.argsort(part, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
    left, found, queue = np.arange(len(sets)), [], []
    seen = np.zeros(len(sets), bool)
    sizes = np.array([len(s) for s in sets])
    built = 0
    while queue or not seen.all():
        left = left[~seen[left]]
        if not len(left):
            break
        if not queue:
            own = members[part[left[0]]]
            seen[own] = True
            queue += own.tolist()
            continue
        if not built or 2 * len(left) <= built:
            words = np.concatenate([sets[i] for i in left])
            by = np.argsort(words, kind="stable")
            words, of, built = words[by], np.repeat(left, sizes[left])[by], len(left)
        x = queue.pop()
        low, high = np.searchsorted(words, sets[x], "left"), np.searchsorted(words, sets[x], "right")
        some = [of[i:j] for i, j in zip(low, high, strict=True) if i < j]
        if some:
            other, common = np.unique(np.concatenate(some), return_counts=True)
            hit = other[~seen[other] & (common >= similarity * (sizes[other] + sizes[x] - common) - 1e-9)]
            for p, first in zip(*np.unique(part[hit], return_index=True), strict=True):
                found.append((x, int(hit[first])))
                seen[members[p]] = True
                queue += members[p].tolist()
    return found


def near_copies(texts: list[str | None], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Positions of linked texts: they connect what all pairs of the similarity connect."""
    return near_links([shingles(t) for t in texts], list(range(len(texts))), similarity)


def _signed(texts: DataFrame) -> DataFrame:
    """text_hash, bands and n rows of each distinct text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("text_hash"), pa.array([bands(t.as_py()) for t in b.column("text")], pa.list_(pa.int64()))], names=["text_hash", "bands"])

    return texts.mapInArrow(trimmed(sign), "text_hash long, bands array<long>").groupBy("text_hash").agg(F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n"))


def _sets(texts: DataFrame) -> DataFrame:
    """text_hash and shingles of each distinct text; a batch sends one of equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = b.column("text_hash").to_numpy()
            at = np.sort(np.unique(hashes, return_index=True)[1])
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array([shingles(b.column("text")[int(i)].as_py()) for i in at], pa.list_(pa.int64()))], names=["text_hash", "grams"])

    return texts.mapInArrow(trimmed(run), "text_hash long, grams array<long>").groupBy("text_hash").agg(F.first("grams").alias("grams"))


def _parts(met: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) of text hashes, rest: text_hash and part of texts in buckets that hold several parts). met: key, text_hash, lead."""
    shared = met.filter("text_hash <> lead").groupBy("text_hash", "lead").agg(F.count(F.lit(1)).alias("times"))
    best = shared.groupBy("text_hash").agg(F.max(F.struct("times", (-F.col("lead")).alias("o"), "lead")).alias("b")).select("text_hash", F.col("b.lead").alias("lead"))
    best = stage(best, "pairs")
    own = best.join(sets.withColumnRenamed("grams", "own"), "text_hash")
    both = attach(own, sets.withColumnRenamed("text_hash", "lead"), "lead", best.groupBy("lead").agg(F.count(F.lit(1)).alias("n")))
    common = F.size(F.array_intersect("own", "grams"))
    similar = both.select("text_hash", "lead", common.alias("common"), (F.size("own") + F.size("grams")).alias("all")).filter(F.col("common") >= SIMILARITY * (F.col("all") - F.col("common")) - 1e-9)
    found = stage(similar.select(F.col("text_hash").alias("a"), F.col("lead").alias("b")), "found")
    parts = connected(found).withColumnRenamed("node", "text_hash")
    labelled = stage(met.join(parts, "text_hash", "left").select("key", "text_hash", F.coalesce("root", "text_hash").alias("part")), "parts")
    buckets = stage(labelled.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("n")), "buckets")
    several = buckets.filter("least <> most")
    return found, stage(attach(labelled, several.select("key"), "key", several.select("key", "n")).select("text_hash", "part").distinct(), "rest")


def _compared(dealt: DataFrame, k: int) -> DataFrame:
    """(a, b): fingerprints of linked texts of different parts. dealt: cluster, i, j, part, text."""

    def verify(group: pa.Table) -> pa.Table:
        texts = group.column("text").to_pylist()
        pairs = np.array(near_links([shingles(t) for t in texts], group.column("part").to_pylist()), np.int64).reshape(-1, 2)
        some = np.unique(pairs)
        fp = dict(zip(some.tolist(), fingerprints([texts[i] for i in some], k).tolist(), strict=True))
        return pa.table([pa.array([fp[i] for i in pairs[:, 0].tolist()], pa.int64()), pa.array([fp[i] for i in pairs[:, 1].tolist()], pa.int64())], names=["a", "b"])

    return dealt.groupBy("cluster", "i", "j").applyInArrow(verify, "a long, b long")


def links(df: DataFrame, text: str = "text", k: int = 3) -> DataFrame:
    """(a, b): SimHash fingerprints, of k-word shingles, of texts that are near copies."""
    texts = df.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    signed = stage(_signed(texts), "bands")
    keys = signed.select(F.explode("bands").alias("key"), "text_hash")
    leads = stage(keys.groupBy("key").agg(F.min("text_hash").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "leads")
    met = stage(attach(keys, leads.select("key", "lead"), "key", leads.select("key", "n")), "buckets")
    found = connected(met.select(F.col("text_hash").alias("a"), F.col("lead").alias("b")))
    clusters = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("text_hash"), F.col("root").alias("cluster"))
    sizes = stage(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n = signed.select("text_hash", "n")
    # A shuffle of texts at every size, so that the plan is that of a large table on a small one too.
    of = lambda hashes: attach(texts, hashes.hint("merge"), "text_hash", n)
    one = lambda t, *others: t.groupBy("text_hash").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in others))
    small = attach(clusters, sizes.filter(F.col("n") <= BLOCK).select("cluster"), "cluster", sizes)
    zero = F.lit(0)
    near = _compared(one(of(small), "cluster").select("cluster", zero.alias("i"), zero.alias("j"), F.col("text_hash").alias("part"), "text"), k)
    if sizes.filter(F.col("n") > BLOCK).take(1):
        large = stage(attach(clusters, sizes.filter(F.col("n") > BLOCK).select("cluster"), "cluster", sizes), "large")
        mine = stage(one(of(large.select("text_hash"))), "texts")
        first, rest = _parts(met.join(large.select("text_hash"), "text_hash", "left_semi"), stage(_sets(mine), "sets"))
        held = rest.join(large, "text_hash")
        blocks = stage(held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")), "blocks").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        dealt = attach(held, blocks.drop("n"), "cluster", blocks.select("cluster", "n")).withColumn("own", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1))).filter("own <> other OR blocks = 1")
        dealt = dealt.select("text_hash", "part", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        print_of = with_fingerprint(mine, "text", k)
        named = first.join(print_of.select(F.col("text_hash").alias("a"), F.col("fp").alias("a_fp")), "a").join(print_of.select(F.col("text_hash").alias("b"), F.col("fp").alias("b_fp")), "b")
        near = near.unionByName(named.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))).unionByName(_compared(dealt.join(mine, "text_hash"), k))
    return stage(near.filter("a <> b").distinct(), "near")
