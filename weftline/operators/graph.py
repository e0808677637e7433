"""Neighbours, seeds, impact and bounded traversal. edges: from_id, to_id, kind, confidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.exprs import edge_allowed, edge_score, is_exported
from weftline.operators import skew
from weftline.staging import stage

#: Lines in a bucket of the line-overlap join.
LINE_BUCKET = 64


def _known(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, neighbor) whose neighbor is a node; a node with a large part of all edges is shared by many tasks."""
    return skew.join(pairs, nodes.select(F.col("id").alias("neighbor")).distinct(), "neighbor", ["id"], skew.hot_keys(pairs, "neighbor"), how="left_semi").select("id", "neighbor")


def neighbors_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, neighbor): what each node refers to; edges to unknown nodes are dropped."""
    return _known(edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("neighbor")), nodes)


def neighbors_in(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, neighbor): what refers to each node."""
    return _known(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("neighbor")), nodes)


def _touched(symbols: DataFrame, changes: DataFrame, whole_file: bool) -> DataFrame:
    lines = changes.select(F.col("path").alias("filepath"), F.explode("changed_lines").alias("line")).withColumn("bucket", F.floor(F.col("line") / LINE_BUCKET)).distinct()
    spans = symbols.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_line") / LINE_BUCKET), F.floor(F.greatest("start_line", "end_line") / LINE_BUCKET))))
    s, c = spans.alias("s"), lines.alias("c")
    on = (F.col("s.filepath") == F.col("c.filepath")) & (F.col("s.bucket") == F.col("c.bucket")) & F.col("c.line").between(F.col("s.start_line"), F.col("s.end_line"))
    hit = s.join(c, on, "left_semi").select("s.id")
    if whole_file:
        files = changes.filter(F.coalesce(F.size("changed_lines"), F.lit(0)) <= 0).select(F.col("path").alias("filepath"))
        hit = hit.unionByName(symbols.join(files, "filepath", "left_semi").select("id"))
    return hit.distinct()


def seeds(symbols: DataFrame, changes: DataFrame) -> DataFrame:
    """Symbols that hold a changed line; a file without listed lines is changed as a whole. Lines are joined by bucket, so a long file does not meet all its symbols."""
    return _touched(symbols, changes, True)


def impact(symbols: DataFrame, edges: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, level): direct, where a changed line falls in the symbol (no lines, no impact); indirect, what refers to these."""
    direct = _touched(symbols, changes, False)
    callers = edges.join(direct.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    return direct.withColumn("level", F.lit("direct")).unionByName(callers.join(direct, "id", "left_anti").withColumn("level", F.lit("indirect")))


def _both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w) for both directions of each pair of nodes. A pair's score is the same either way, so pairs are shuffled and grouped once, whatever the direction."""
    ahead = F.coalesce(F.col("from_id") <= F.col("to_id"), F.col("from_id").isNull())
    a, b = F.when(ahead, F.col("from_id")).otherwise(F.col("to_id")), F.when(ahead, F.col("to_id")).otherwise(F.col("from_id"))
    pairs = edges.select(a.alias("a"), b.alias("b"), edge_score(F.col("confidence")).alias("w"))
    pairs = skew.spread(pairs, 2 * edges.count(), "a", "b").groupBy("a", "b").agg(F.max("w").alias("w"))
    ends = F.array_distinct(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return pairs.select(F.explode(ends).alias("e"), "w").select("e.u", "e.v", "w")


def expand(edges: DataFrame, start: DataFrame, hops: int = 2, least: float = 0.0, kinds: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reached from start (id) in at most ``hops`` steps either way.

    nodes: id, depth, score. Round by round, the nodes found last are expanded with the score they have then, a
    node's score is the largest product of edge scores that reaches it, and each node is expanded once.

    Edges lead both ways, so what a round finds is new unless it stands in one of the last two rounds: a round joins its frontier with
    the edges, compares with these two, and leaves all earlier nodes alone. A hub's edges are shared by many tasks. Edges are staged first and
    counted, since their number says how many tasks share them.
    """
    keep = stage if hops > 1 else lambda df, _: df
    allowed = stage(edges.filter(edge_allowed(F.col("confidence"), F.col("kind"), least, kinds)), "edges")
    near = keep(_both_ways(allowed), "near")
    hubs = skew.hot_keys(near, "u")
    last = keep(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(1.0).alias("score")), "start")
    before, rounds = last.limit(0), [last]
    for depth in range(1, hops + 1):
        met = skew.join(near, last.select(F.col("id").alias("u"), "score"), "u", ["v"], hubs)
        found = met.groupBy(F.col("v").alias("id")).agg(F.max(F.col("score") * F.col("w")).alias("score")).select("id", F.lit(depth).alias("depth"), "score")
        if depth < hops:
            found = stage(found, "frontier")
        rounds.append(found)
        before, last = last, found.join(last.select("id").unionByName(before.select("id")), "id", "left_anti")
    nodes = reduce(DataFrame.unionByName, rounds).groupBy("id").agg(F.min("depth").alias("depth"), F.max("score").alias("score"))
    inner = reduce(DataFrame.unionByName, rounds[:hops] or [last.limit(0)]).select("id").distinct()
    ends = allowed.select("*", F.explode(F.array("from_id", "to_id")).alias("id"))
    ends = skew.join(ends, inner, "id", ["from_id", "to_id"], hubs.withColumnRenamed("u", "id"), how="left_semi").drop("id")
    return nodes, ends.dropDuplicates(["from_id", "to_id", "kind"])


def distances(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(id, depth) of nodes at 1 to ``most`` undirected steps from start (id), which is left out."""
    plain = edges.select("from_id", "to_id", F.lit("").alias("kind"), F.lit(1.0).alias("confidence"))
    nodes, _ = expand(plain, start, most)
    return nodes.filter("depth > 0").select("id", "depth")


def distances_each(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(query_id, id, depth) of nodes at 1 to ``most`` undirected steps from each query's starts (query_id, id), which are left out.

    One traversal serves all queries: its frontier holds pairs of a query and a node. A round joins the pairs found last with the
    edges, which are staged once, and those in neither of the last two rounds are the next; a pair is expanded once. A hub's edges, and
    the queries that meet in one node, are shared by many tasks.
    """
    ends = F.array(F.struct(F.col("from_id").alias("u"), F.col("to_id").alias("v")), F.struct(F.col("to_id").alias("u"), F.col("from_id").alias("v")))
    near = stage(edges.select(F.explode(ends).alias("e")).select("e.u", "e.v").distinct(), "near")
    hubs = skew.hot_keys(near, "u")
    last = stage(starts.select("query_id", "id", F.lit(0).alias("depth")).distinct(), "start")
    before = last.limit(0)
    rounds = [before]
    for depth in range(1, most + 1):
        asked = last.select("query_id", F.col("id").alias("u"))
        found = skew.join(near, asked, "u", ["v"], hubs, skew.hot_keys(asked, "u"), ["query_id"]).select("query_id", F.col("v").alias("id")).distinct()
        new = found.join(last.unionByName(before), ["query_id", "id"], "left_anti").withColumn("depth", F.lit(depth))
        before, last = last, stage(new, "frontier")
        rounds.append(last)
    return reduce(DataFrame.unionByName, rounds)


def doc_relevant(symbols: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(id) of symbols that are exported or within ``hops`` undirected steps of one that is."""
    nodes, _ = expand(edges.withColumn("confidence", F.lit(1.0)), symbols.filter(is_exported(F.col("name"))), hops)
    return symbols.join(nodes.select("id"), "id", "left_semi").select("id")


def update_symbols(symbols: DataFrame, changes: DataFrame, extracted: DataFrame) -> DataFrame:
    """Symbols less those of changed paths, and those newly extracted."""
    return symbols.join(changes.select(F.col("path").alias("filepath")), "filepath", "left_anti").unionByName(extracted)


def files(symbols: DataFrame) -> DataFrame:
    """(path) of symbols, without blanks."""
    return symbols.select(F.col("filepath").alias("path")).filter("trim(path) <> ''").distinct()


def deleted_files(symbols: DataFrame, present: DataFrame) -> DataFrame:
    """(path) of symbols' files that are no longer present (path)."""
    return files(symbols).join(present.select("path"), "path", "left_anti")
