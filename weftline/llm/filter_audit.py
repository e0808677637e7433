"""How filters interact: a Walsh-Hadamard audit of every order of five filters.

A document's mask has bit i set if it fails filter i. Which documents an order removes at
which step depends on nothing but the masks, so 32 numbers for each part and label say all.
They are gathered as the 32 parity sums ``S[k] = sum((-1) ** bit_count(mask & k))``, one
aggregate with partial sums, and inverted exactly: ``cell[m] = sum((-1) ** bit_count(m & k) * S[k]) / 32``.
From the cells follow, for every order and step, what is kept, removed, redundant and lost; and
as each of a document's n failed filters comes first in 120 / n of the orders, a filter's
removals over all orders are ``sum(cell[m] * 120 / bit_count(m))`` over its cells, no order played.

Filters A to D look at one text. E (a smaller id has the same text) compares 128-bit digests: each
digest's smallest id is a partial aggregate, and rows meet it through ``skew.attach``, so a text
that a third of all rows share is split. Only narrow rows (id, part, digest, bits) are staged or
shuffled; a text is read once, whole.

A null text is empty, and equals an empty one. A null part is the empty string. Rows of one
id and text are not each other's copies; a null id comes after all ids, fails E where any id has
its text, and has no label. Several labels of an id count as one, good or toxic if any says so. An
empty table has no parts and gives no rows. Further columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import skew
from weftline.llm.workers import trimmed
from weftline.staging import drop, stage

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: In hundredths: distinct words of all words at least, capital letters of all code points at most.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SYMBOLS = "#$%&*|"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOL_BYTES = SYMBOLS.encode()


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that a text fails. ``bytes.split`` splits at the six white-space bytes of the word rule."""
    raw = (text or "").encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    failed = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * len(text or ""),
        len(raw.translate(None, _SYMBOL_BYTES)) < len(raw),
    )
    return sum(f << i for i, f in enumerate(failed))


def _measured(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, digest, bits) of each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, bits = [], []
            for x in b.column("text"):
                t = x.as_py()
                digests.append(xxhash.xxh3_128_digest((t or "").encode()))
                bits.append(text_mask(t))
            columns = [b.column("doc_id"), b.column("part"), pa.array(digests, pa.binary()), pa.array(bits, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "bits"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, part string, digest binary, bits int")


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask): which of the five filters each row of docs fails."""
    rows = stage(_measured(docs, doc_id, text, part), "audit")
    texts = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "copies")
    met = skew.attach(rows, texts.drop("n"), "digest", texts.select("digest", "n"))
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("first_id").isNotNull())
    return met.select("doc_id", "part", (F.col("bits") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """rows with good and toxic, 0 or 1. Rows without an id meet nothing, and stay where they are."""
    has = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("good"), F.col(toxic).alias("toxic"))
    own = own.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(has("good"), has("toxic"))
    known = rows.filter(F.col("doc_id").isNotNull()).join(own, "doc_id", "left")
    known = known.select(*rows.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    return known.unionByName(rows.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(0), "toxic": F.lit(0)}))


def parity_sums(rows: DataFrame) -> DataFrame:
    """For each part and label (all, good, toxic) the array of MASKS signed sums over its rows' masks."""
    weights = {"all": F.lit(1).cast("long"), "good": F.col("good").cast("long"), "toxic": F.col("toxic").cast("long")}
    sign = [F.lit(1) - 2 * F.bit_count(F.col("mask").bitwiseAND(F.lit(k))).bitwiseAND(F.lit(1)) for k in range(MASKS)]
    sums = [F.sum(w * sign[k]).alias(f"{name}_{k}") for name, w in weights.items() for k in range(MASKS)]
    return rows.groupBy("part").agg(*sums).select("part", *(F.array(*(f"{name}_{k}" for k in range(MASKS))).alias(name) for name in weights))


def cells(sums: Column) -> Column:
    """The rows of each mask, from the parity sums: the transform is its own inverse but for the factor."""

    places = F.sequence(F.lit(0), F.lit(MASKS - 1))

    def cell(m: Column) -> Column:
        signed = F.zip_with(sums, places, lambda s, k: s * (1 - 2 * F.bit_count(m.bitwiseAND(k)).bitwiseAND(F.lit(1))))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x), len(FILTERS))

    return F.transform(places, cell)


def _total(column: str, wanted, weight=None) -> Column:
    """The sum over the cells m for which wanted(m) holds, a Column expression in m."""

    def value(n: Column, m: Column) -> Column:
        return F.when(wanted(m), n if weight is None else n * weight(m)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.col(column), value), F.lit(0).cast("long"), lambda a, x: a + x)


def audit(rows: DataFrame) -> DataFrame:
    """Every order and step for each part of rows (part, mask, good, toxic)."""
    found = parity_sums(rows).select("part", *(cells(F.col(c)).alias(c) for c in ("all", "good", "toxic")))
    steps = [(o, i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:i])) for o in ORDERS for i, f in enumerate(o)]
    plan = F.from_json(F.lit(_json(steps)), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    found = found.withColumn("s", F.explode(plan)).select("*", "s.*")
    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    passed = lambda m: m.bitwiseAND(before) == 0
    here = lambda m: fails(m) & passed(m)
    return found.select(
        "part", "filter_order", "step",
        _total("all", lambda m: ~fails(m) & passed(m)).alias("kept"),
        _total("all", here).alias("removed"),
        _total("all", lambda m: fails(m) & ~passed(m)).alias("redundant"),
        _total("all", lambda m: m == own).alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        _total("all", fails, lambda m: F.floor(F.lit(len(ORDERS)) / F.greatest(F.bit_count(m), F.lit(1)))).alias("shapley"),
    )


def _json(steps: list[tuple[str, int, int, int]]) -> str:
    return "[" + ",".join(f'{{"filter_order":"{o}","step":{i},"own":{f},"before":{b}}}' for o, i, f, b in steps) + "]"


def run(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of documents (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    rows = stage(masks(docs), "masks")
    out = stage(audit(labelled(rows, labels)), "audited")
    drop(rows)
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
m AS (SELECT doc_id, part,
    (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text))::INT AS c,
    regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > first_id, first_id IS NOT NULL)::INT AS e
  FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
k AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM o, range(1, 6) g(step)),
i AS (SELECT part, s.*, mask, n, good, toxic, mask & own <> 0 AS fails, mask & before = 0 AS passed FROM k, s)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (NOT fails AND passed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND passed), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND NOT passed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND passed), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND passed), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (fails), 0)::BIGINT AS shapley
FROM i GROUP BY part, filter_order, step
"""
