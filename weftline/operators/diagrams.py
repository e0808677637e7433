"""Package and stage diagrams from chunks. Counts are aggregates; only the few rows that are drawn become text.

``by`` names columns of chunks, such as a section: each group has a diagram of its own, all in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import diagram_id, most_hits, trim_ws
from weftline.operators.order import first_rows

# Stages in order with their labels and words.
STAGES = (
    ("entry", "Entry/API", "main cmd api handler controller router endpoint serve"),
    ("app", "Orchestration", "service orchestr pipeline runner sync workflow manager"),
    ("domain", "Domain Logic", "domain core resolver analy planner extract generator"),
    ("data", "Storage/Index", "store repo db sqlite index cache vector"),
    ("output", "Output", "doc render markdown writer export"),
)
TOP_PACKAGES, TOP_EDGES, CHAIN = 8, 10, 6


def stage_of() -> Column:
    """Number of the stage with most words in name, package and description, the first of equals; null without any."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("name", "package", "description"))))
    return most_hits(text, [words.split() for _, _, words in STAGES])


def package_counts(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return chunks.filter(F.coalesce("package", F.lit("")) != "").groupBy(*by, "package").agg(F.count(F.lit(1)).alias("n"))


def main_package(chunks: DataFrame) -> DataFrame:
    """One row, package: the most frequent, the first by name of equals, ``project`` without any."""
    top = package_counts(chunks).agg(F.min(F.struct((-F.col("n")).alias("o"), "package")).alias("t"))
    return top.select(F.coalesce("t.package", F.lit("project")).alias("package"))


def package_chain(chunks: DataFrame, k: int = CHAIN, by: Sequence[str] = ()) -> DataFrame:
    """(package, n, next) of the k most frequent packages in order."""
    order = [F.desc("n"), F.asc("package")]
    top = first_rows(package_counts(chunks, by), order, k, by)
    return top.withColumn("next", F.lead("package").over(Window.partitionBy(*by).orderBy(*order)))


def package_edges(chunks: DataFrame, names: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(from_pkg, to_pkg, w): dependencies by name between packages. A name of several packages counts for the first by name."""
    packed = chunks.filter(F.coalesce("package", F.lit("")) != "")
    if names is None:
        symbols = packed.filter(~F.col("unit_type").isin("file_module", "symbol_segment"))
        names = symbols.groupBy(*by, F.col("name").alias("dep")).agg(F.min("package").alias("to_pkg"))
    deps = packed.select(*by, F.col("package").alias("from_pkg"), F.explode("dependencies").alias("dep"))
    counted = deps.groupBy(*by, "from_pkg", "dep").agg(F.count(F.lit(1)).alias("n"))
    between = counted.join(names, [*by, "dep"]).filter("from_pkg <> to_pkg")
    return between.groupBy(*by, "from_pkg", "to_pkg").agg(F.sum("n").alias("w"))


def snapshot_edges(chunks: DataFrame, packages: int = TOP_PACKAGES, edges: int = TOP_EDGES, by: Sequence[str] = ()) -> DataFrame:
    """The heaviest edges between the most frequent packages."""
    top = first_rows(package_counts(chunks, by), [F.desc("n"), F.asc("package")], packages, by)
    e = package_edges(chunks, by=by)
    for end in ("from_pkg", "to_pkg"):
        e = e.join(top.select(*by, F.col("package").alias(end)), [*by, end], "left_semi")
    return first_rows(e, [F.desc("w"), F.asc("from_pkg"), F.asc("to_pkg")], edges, by)


def stage_edges(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(from_stage, to_stage, w) by names that chunks depend on and that use them; a name's stage is its first."""
    staged = chunks.withColumn("stage", stage_of()).filter("stage IS NOT NULL")
    names = staged.filter(F.trim("name") != "").groupBy(*by, "name").agg(F.min("stage").alias("other"))
    way = lambda col, forward: staged.select(*by, "stage", F.explode(F.transform(col, lambda x: F.trim(x))).alias("name")).groupBy(*by, "stage", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("forward", F.lit(forward))
    met = way("dependencies", True).unionByName(way("used_by", False)).join(names, [*by, "name"]).filter("stage <> other")
    ends = met.select(*by, F.when(F.col("forward"), F.col("stage")).otherwise(F.col("other")).alias("from_stage"), F.when(F.col("forward"), F.col("other")).otherwise(F.col("stage")).alias("to_stage"), "n")
    return ends.groupBy(*by, "from_stage", "to_stage").agg(F.sum("n").alias("w"))


def stage_packages(chunks: DataFrame, k: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """(stage, package, n, rn): the k most frequent packages of each stage."""
    g = chunks.withColumn("stage", stage_of()).filter("stage IS NOT NULL AND trim(coalesce(package, '')) <> ''").groupBy(*by, "stage", "package").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rn", F.row_number().over(Window.partitionBy(*by, "stage").orderBy(F.desc("n"), "package"))).filter(F.col("rn") <= k)


def stage_flow(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(stage, hits, next_stage): each stage that occurs, and the later stage of its heaviest edge, if any."""
    seen = chunks.withColumn("stage", stage_of()).filter("stage IS NOT NULL").groupBy(*by, "stage").agg(F.count(F.lit(1)).alias("hits"))
    best = stage_edges(chunks, by).filter("to_stage > from_stage").groupBy(*by, F.col("from_stage").alias("stage")).agg(F.min(F.struct((-F.col("w")).alias("o"), "to_stage")).alias("b"))
    return seen.join(best, [*by, "stage"], "left").select(*by, "stage", "hits", F.col("b.to_stage").alias("next_stage"))


def _text(rows: DataFrame, lines: Column, order: Column, head: str, by: Sequence[str] = ()) -> DataFrame:
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), lines.alias("t")))), lambda x: x["t"]), "")
    return rows.groupBy(*by).agg(F.concat(F.lit(f"```mermaid\n{head}\n"), parts, F.lit("```\n")).alias("diagram"))


def architecture_snapshot(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, diagram, of all chunks or of each group: packages and their edges, or a chain of packages without edges."""
    heavy = [F.desc("n"), F.asc("package")]
    in_order = lambda *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    arrow = lambda a, b: F.concat(F.lit("    "), diagram_id(F.col(a)), F.lit(" --> "), diagram_id(F.col(b)), F.lit("\n"))
    top = first_rows(package_counts(chunks, by), heavy, TOP_PACKAGES, by)
    box = F.concat(F.lit("    "), diagram_id(F.col("package")), F.lit('["'), F.col("package"), F.lit('"]\n'))
    nodes = top.select(*by, in_order(*heavy).alias("o"), box.alias("t"))
    edges = snapshot_edges(chunks, by=by)
    place = in_order(F.desc("w"), F.asc("from_pkg"), F.asc("to_pkg")) + 100
    drawn = edges.select(*by, place.alias("o"), arrow("from_pkg", "to_pkg").alias("t"))
    chain = package_chain(chunks, TOP_PACKAGES, by).filter("next IS NOT NULL")
    if by:
        chain = chain.join(edges.select(*by), [*by], "left_anti")
    else:
        none = edges.agg((F.count(F.lit(1)) == 0).alias("none"))
        chain = chain.crossJoin(F.broadcast(none)).filter("none")
    chain = chain.select(*by, (in_order(*heavy) + 100).alias("o"), arrow("package", "next").alias("t"))
    return _text(nodes.unionByName(drawn).unionByName(chain), F.col("t"), F.col("o"), "graph LR", by)


def architecture_flow(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, diagram, of all chunks or of each group: stages that occur with their main packages, and an edge from each to the later stage it leads to most."""
    label = F.element_at(F.array(*(F.lit(s[1]) for s in STAGES)), F.col("stage") + 1)
    key = lambda c: F.element_at(F.array(*(F.lit(s[0]) for s in STAGES)), c + 1)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "package"))), lambda x: x["package"]), ", ")
    packs = stage_packages(chunks, by=by).groupBy(*by, "stage").agg(listed.alias("packs"))
    flow = stage_flow(chunks, by).join(packs, [*by, "stage"], "left")
    told = F.coalesce(F.concat(F.lit(" ("), F.col("packs"), F.lit(")")), F.lit(""))
    box = F.concat(F.lit("    "), key(F.col("stage")), F.lit('["'), label, told, F.lit('"]\n'))
    arrow = F.concat(F.lit("    "), key(F.col("stage")), F.lit(" --> "), key(F.col("next_stage")), F.lit("\n"))
    nodes = flow.select(*by, F.col("stage").cast("long").alias("o"), box.alias("t"))
    edges = flow.filter("next_stage IS NOT NULL").select(*by, (F.col("stage") + 100).cast("long").alias("o"), arrow.alias("t"))
    return _text(nodes.unionByName(edges), F.col("t"), F.col("o"), "graph TD", by)


def package_flow(chunks: DataFrame) -> DataFrame:
    chain = package_chain(chunks).filter("next IS NOT NULL")
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "package")).cast("long")
    rows = chain.select(rank.alias("o"), F.concat(F.lit("    "), diagram_id(F.col("package")), F.lit(" --> "), diagram_id(F.col("next")), F.lit("\n")).alias("t"))
    return _text(rows, F.col("t"), F.col("o"), "graph TD")


def with_diagram(content: Column, heading: str | Column, diagram: Column) -> Column:
    """Content with the diagram under its heading: in place of one that stands there, or else put there, or at the end."""
    head = F.lit(heading) if isinstance(heading, str) else heading
    text, block = trim_ws(content), trim_ws(diagram)
    at = F.instr(text, head)
    before = F.concat(F.substr(text, F.lit(1), at - 1), head)
    after = F.regexp_replace(F.substr(text, at + F.length(head)), r"(?s)^\n*(?:```mermaid.*?```)?\n*", "")
    placed = F.concat(before, F.lit("\n\n"), block, F.when(after == "", "").otherwise(F.concat(F.lit("\n\n"), after)))
    new = F.concat(F.when(text == "", "").otherwise(F.concat(text, F.lit("\n\n"))), head, F.lit("\n\n"), block)
    return F.when(at > 0, placed).otherwise(new)
