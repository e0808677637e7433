"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's rate is its target over its size, so a document's expected copies are the
rate. Within a source documents stand in order of size; one random offset is added to
the prefix sum of expected copies, and a document is emitted once for each integer
boundary that its part of the sum crosses. Order by size makes the words taken follow
the target to within about one large document.

Words are counted once, and only narrow rows (source, size, id, hashes) are staged and
sorted; texts meet their copies by hash, and move once. The order is a range sort of all
narrow rows by (source, size, id, hashes), so a source that holds a third of the rows
spreads over many tasks; a document's position in its source is its place in its task plus
the rows of the source in earlier tasks, a table of at most one row for each task and
source. Sources are numbered and summed by the same kind of sort, so many of them need no
task of their own. The hashes are of all columns, so rows that differ anywhere keep their
place in every run; rows that are equal in all columns (maps and variants have no hash
and are not compared) are copies of one row.

Null text has size 0. A null source is a source, the last one. Null ids and repeated
rows are rows like any other. A source whose size is 0 has target 0 and gives nothing.
Empty tables give no rows. Columns of the input named like an added one are replaced. A
text of any length is one row, counted by one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.order import sorted_tasks, summed
from weftline.staging import stage

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix"
#: Before names that exist inside a plan only.
_OWN = "_weftline_mix_"
ADDED = ("size", "source_size", "target", "copies", "taken")
_KEY = (_OWN + "hash", _OWN + "check")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sizes (source, source_size) with target: weights share all words, a target stops at ``most`` times its source's size.

    Sources that fill up first are those of least size for their weight. With the first k of
    these full, the rest have a level of (all words - their caps) / (all weights - theirs)
    for each unit of weight; the answer is the first k whose level the next source can hold, the highest level that fits.
    """
    cycle = F.array(*map(F.lit, weights))
    w = summed(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()], "sources")
    w = w.withColumn("weight", F.element_at(cycle, (F.col("row") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size")).drop("row")
    fill = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    w = summed(w, fill, "fill", full=F.col("cap"), spent=F.col("weight"))
    words, parts = w.agg(F.sum("source_size"), F.sum("weight")).first()
    w = w.withColumn("level", (F.lit(words) - F.col("full")) / (F.lit(parts) - F.col("spent")))
    reached = w.agg(F.coalesce(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))), F.max("level"))).first()[0]
    return w.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(reached).cast("double") * F.col("weight")).alias("target"))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _keys(df: DataFrame) -> dict[str, Column]:
    """Two hashes of all columns that have one: 96 bits."""
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)]
    return dict(zip(_KEY, (F.xxhash64(*columns), F.hash(*columns)), strict=True))


def copies(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """A narrow row for each of ``df``: doc_id, source, size, source_size, target, copies (0 to ``most``), taken (copies times size), and the row's hashes."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), *(c.alias(n) for n, c in _keys(df).items()))
    rows = stage(rows, "sizes")
    placed = sorted_tasks(rows, [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_last(), *map(F.asc, _KEY)], "mix")
    runs = placed.groupBy("source", "task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # A null source is a name of its own here, so that it joins like others.
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    start = runs.withColumn("before", before).join(goal.withColumn("name", name(F.col("source"))).drop("source"), name(F.col("source")) == F.col("name"))
    start = start.select("name", F.col("task").alias("own_task"), "first", "before", "source_size", "target")
    placed = placed.join(start, (name(F.col("source")) == F.col("name")) & (F.col("task") == F.col("own_task")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = rate - F.floor(rate)
    offset = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(2.0**20)
    index = F.col("at") - F.col("first") + F.col("before")
    crossed = F.floor((index + 1) * part + offset) - F.floor(index * part + offset)
    placed = placed.withColumn("copies", (F.floor(rate) + crossed).cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *_KEY)


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """``df`` with size, source_size, target, copies and taken, a row for each row."""
    df = df.drop(*ADDED)
    found = stage(copies(df, doc_id, source, text, weights, most, seed), "copies")
    return _beside(df, found, [F.col(c) for c in ADDED])


def _beside(df: DataFrame, found: DataFrame, added: list[Column], wanted: Column | None = None) -> DataFrame:
    """Rows of ``df`` with columns of their rows in found that are wanted. Of rows that are equal in all columns the first goes on, as often as found wants it."""
    keyed = df.withColumns(_keys(df))
    repeated = found.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    some = (found if wanted is None else found.filter(wanted)).select(*_KEY, *added)
    if not repeated.take(1):
        return keyed.join(some, list(_KEY)).drop(*_KEY)
    once = keyed.join(some.join(repeated, list(_KEY), "left_anti"), list(_KEY))
    again = keyed.join(repeated, list(_KEY), "left_semi").dropDuplicates(list(_KEY)).join(some.join(repeated, list(_KEY), "left_semi"), list(_KEY))
    return once.unionByName(again).drop(*_KEY)


def mixed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """Rows of ``df`` as often as the mix takes them. Only rows that it takes meet their copies."""
    found = stage(copies(df, doc_id, source, text, weights, most, seed).select(F.col("copies").alias(_OWN + "copies"), *_KEY), "copies")
    return emit(_beside(df, found, [F.col(_OWN + "copies")], F.col(_OWN + "copies") > 0), _OWN + "copies").drop(_OWN + "copies")


def emit(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as its copies."""
    number = _OWN + "number"
    return df.filter(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(number)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS filled, coalesce(sum(weight) OVER b, 0) AS spent, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM w WINDOW b AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (words - filled)::DOUBLE / (weights - spent)::DOUBLE AS level FROM f),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), max(level) OVER ()) * weight) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || left(md5(coalesce(d.source, '') || ':mix'), 5))::BIGINT / 1048576.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) - 1 AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate) + floor((i + 1) * (rate - floor(rate)) + u) - floor(i * (rate - floor(rate)) + u))::BIGINT AS taken
FROM r
"""
