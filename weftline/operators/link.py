"""Name resolution: from relations that name a target to edges between symbols.

relations: from_id, ord, target, kind, resolver, confidence. symbols: id, name, package.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import blank
from weftline.operators import skew
from weftline.operators.typed import method_index


def name_index(symbols: DataFrame) -> DataFrame:
    """(key, id): a symbol is found by its name and by package.name."""
    keys = F.array(F.col("name"), F.concat_ws(".", "package", "name"))
    return symbols.select(F.explode(keys).alias("key"), "id").distinct()


def key_index(symbols: DataFrame) -> DataFrame:
    """``name_index``, and methods by package.receiver.name where symbols have their receivers."""
    index = name_index(symbols)
    return index.unionByName(method_index(symbols)).distinct() if {"receiver", "unit_type"} <= set(symbols.columns) else index


def candidate_keys(target) -> list:
    """In order: the target less one ``*`` and one ``[]``, as it is, and what follows its last dot."""
    clean = F.regexp_replace(F.regexp_replace(target, r"^\*", ""), r"^\[\]", "")
    return [clean, target, F.when(F.contains(clean, F.lit(".")), F.substring_index(clean, ".", -1))]


def link(relations: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved). The first key with any match decides, and every symbol that matches it gets an edge.

    Relations are joined by key, and a name that many relations use, or many symbols bear, is shared by many tasks. The
    choice of key is an aggregate of one row for each relation, not a window over its matches. Relations that ask alike are
    one before they meet symbols, so edges are shuffled only where a symbol's relations of a kind have several keys, which may lead to one edge twice.
    """
    keyed = relations.select("*", F.posexplode(F.array(*candidate_keys(F.col("target")))).alias("step", "key")).filter("key IS NOT NULL AND key <> ''")
    index = name_index(symbols)
    hot, row = skew.hot_keys(keyed, "key"), ["from_id", "ord"]
    known = skew.join(keyed, index.select("key").distinct(), "key", row, hot, how="left_semi")
    first = known.groupBy("from_id", "ord").agg(F.min(F.struct("step", "key")).alias("best")).select("from_id", "ord", F.col("best.key").alias("key"))
    asked = relations.join(first, row).groupBy("from_id", "kind", "key").agg(F.max_by("resolver", "confidence").alias("resolver"), F.max("confidence").alias("confidence"))
    asked = asked.withColumn("keys", F.count(F.lit(1)).over(Window.partitionBy("from_id", "kind")))
    met = skew.join_many(asked, index, "key", ["from_id", "kind"], hot, ["id"])
    met = met.select("from_id", F.col("id").alias("to_id"), "kind", "resolver", "confidence", "keys")
    again = met.filter("keys > 1").groupBy("from_id", "to_id", "kind").agg(F.max_by("resolver", "confidence").alias("resolver"), F.max("confidence").alias("confidence"))
    edges = met.filter("keys = 1").drop("keys").unionByName(again)
    missing = relations.join(first, ["from_id", "ord"], "left_anti").select("from_id", "ord", "target", "kind", "resolver", "confidence", F.lit("no_candidate").alias("reason"))
    return edges, missing


def link_within_package(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges as of ``link``, but of several symbols of a name only those of the relation's own package, where it has one."""
    edges, _ = link(relations, symbols)
    home = symbols.select(F.col("id").alias("from_id"), F.col("package").alias("home"))
    away = symbols.select(F.col("id").alias("to_id"), "package", "name")
    placed = edges.join(home, "from_id", "left").join(away, "to_id")
    own = F.max(F.col("home") == F.col("package")).over(Window.partitionBy("from_id", "kind", "name"))
    return placed.withColumn("own", own).filter(~F.coalesce("own", F.lit(False)) | (F.col("home") == F.col("package"))).select(edges.columns)


def resolve_unique(unresolved: DataFrame, node_keys: DataFrame, edges: DataFrame, typed_refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed resolution of leftovers: (new edges, still unresolved).

    Keys come from ``typed_refs`` (from_id, ord, key) where there are any, else from the target. A relation with
    exactly one symbol behind its keys gets an edge of confidence 0.9 at least; more are ambiguous. Only a key's first and
    last symbol meet relations, so a name that many symbols bear costs a relation no more than another.
    """
    fallback = unresolved.select("from_id", "ord", F.explode(F.array_distinct(F.array(*candidate_keys(F.col("target"))))).alias("key"))
    if typed_refs is not None:
        typed = typed_refs.select("from_id", "ord", "key")
        fallback = fallback.join(typed.select("from_id", "ord").distinct(), ["from_id", "ord"], "left_anti").unionByName(typed)
    ends = node_keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    least, most = F.min("least"), F.max("most")
    n = F.when(least == most, 1).when(least < most, 2).otherwise(0)
    found = fallback.join(ends, "key").groupBy("from_id", "ord").agg(n.alias("n"), least.alias("to_id"))
    judged = unresolved.join(found, ["from_id", "ord"], "left")
    new = judged.filter("n = 1").select("from_id", "to_id", "kind", F.lit("types").alias("resolver"), F.greatest("confidence", F.lit(0.9)).alias("confidence"))
    new = new.groupBy("from_id", "to_id", "kind").agg(F.first("resolver").alias("resolver"), F.max("confidence").alias("confidence")).join(edges, ["from_id", "to_id", "kind"], "left_anti")
    rest = judged.filter("coalesce(n, 0) <> 1").withColumn("reason", F.when(F.col("n") > 1, "ambiguous").otherwise("typecheck_failed")).select(unresolved.columns)
    return new, rest


def link_typed(relations: DataFrame, symbols: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) as of ``link``, but a relation with exactly one symbol behind its references (from_id, ord, key) is linked to that one only."""
    none = relations.limit(0).select("from_id", F.lit("").alias("to_id"), "kind", "resolver", "confidence")
    asked = relations.join(refs.select("from_id", "ord").distinct(), ["from_id", "ord"], "left_semi").withColumn("reason", F.lit(""))
    sure, rest = resolve_unique(asked, key_index(symbols), none, refs)
    others = relations.join(refs.select("from_id", "ord").distinct(), ["from_id", "ord"], "left_anti").unionByName(rest.select(relations.columns))
    edges, missing = link(others, symbols)
    both = sure.unionByName(edges)
    return both.groupBy("from_id", "to_id", "kind").agg(F.max_by("resolver", "confidence").alias("resolver"), F.max("confidence").alias("confidence")), missing


def reason_counts(unresolved: DataFrame) -> DataFrame:
    reason = F.when(blank(F.col("reason")), "no_candidate").otherwise(F.col("reason"))
    return unresolved.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


Resolver = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def run_chain(edges: DataFrame, unresolved: DataFrame, resolvers: Sequence[tuple[str, Resolver]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, unresolved, stages): each resolver takes what the one before left. stages: stage, name, before_n, after_n, resolved."""
    spark, counts = edges.sparkSession, None
    before = unresolved.agg(F.count(F.lit(1)).alias("before_n"))
    for i, (name, resolver) in enumerate(resolvers):
        new, unresolved = resolver(edges, unresolved)
        edges = edges.unionByName(new)
        after = unresolved.agg(F.count(F.lit(1)).alias("after_n"))
        row = before.crossJoin(after).select(F.lit(i).alias("stage"), F.lit(name).alias("name"), "before_n", "after_n", (F.col("before_n") - F.col("after_n")).alias("resolved"))
        counts = row if counts is None else counts.unionByName(row)
        before = after.withColumnRenamed("after_n", "before_n")
    return edges, unresolved, counts if counts is not None else spark.createDataFrame([], "stage int, name string, before_n long, after_n long, resolved long")
