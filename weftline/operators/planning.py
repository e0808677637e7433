"""Which sections a change affects, and where unmatched chunks go."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import clamp, section_by_heuristic
from weftline.operators.order import summed
from weftline.operators.vector import assign
from weftline.staging import stage

# A hit symbol scores 1 and a fifth of its combined confidence, a hit file 0.35 at confidence 0.3; a node without score counts 0.45.
SYMBOL_SCORE, SYMBOL_SHARE, FILE_SCORE, FILE_CONFIDENCE, UNSCORED = 1.0, 0.2, 0.35, 0.3, 0.45
CANONICAL = ("overview", "key-features", "development")


def section_impact(sources: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Sections hit by nodes (id, score) or files (path): score, confidence, symbols, files.

    sources: section_id, symbol_id, file_path, confidence. A symbol's combined confidence is the mean of the
    node's score and the source's confidence, or the score alone where the source has none.
    """
    s = sources.join(nodes.select(F.col("id").alias("symbol_id"), F.when(F.col("score") > 0, F.col("score")).otherwise(UNSCORED).alias("node_score")), "symbol_id", "left")
    s = s.join(files.select(F.col("path").alias("file_path"), F.lit(True).alias("file_hit")).distinct(), "file_path", "left")
    has = F.coalesce("confidence", F.lit(0.0)) > 0
    combined = F.when(F.col("node_score").isNotNull(), F.when(has, (F.col("node_score") + F.col("confidence")) / 2).otherwise(F.col("node_score")))
    s = s.withColumn("combined", combined)
    hit_file = F.col("file_hit") == True  # noqa: E712
    g = s.groupBy("section_id").agg(
        F.count("combined").alias("ns"), F.coalesce(F.sum("combined"), F.lit(0.0)).alias("cs"), F.count_if(hit_file).alias("nf"),
        F.array_sort(F.collect_set(F.when(F.col("combined").isNotNull(), F.col("symbol_id")))).alias("symbols"), F.array_sort(F.collect_set(F.when(hit_file, F.col("file_path")))).alias("files"),
    )
    score = F.col("ns") * SYMBOL_SCORE + SYMBOL_SHARE * F.col("cs") + FILE_SCORE * F.col("nf")
    confidence = (F.col("cs") + FILE_CONFIDENCE * F.col("nf")) / (F.col("ns") + F.col("nf"))
    g = g.filter((F.col("ns") > 0) | (F.col("nf") > 0)).withColumns({"score": F.round(score, 6), "confidence": F.round(clamp(confidence, 0.0, 1.0), 6)})
    return g.select("section_id", "score", "confidence", F.col("ns").alias("symbol_hits"), F.col("nf").alias("file_hits"), "symbols", "files")


def by_impact() -> list[Column]:
    return [F.desc("confidence"), F.desc("score"), F.asc("section_id")]


def unmatched_symbols(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    return nodes.select("id").join(sources.select(F.col("symbol_id").alias("id")), "id", "left_anti")


def route_by_file(chunks: DataFrame, section_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matched: id, section_id; unmatched: chunks no section refers to by file)."""
    pairs = section_files.select("section_id", "file_path").distinct()
    return chunks.join(pairs, "file_path").select("id", "section_id"), chunks.join(pairs.select("file_path").distinct(), "file_path", "left_anti").select(chunks.columns)


def route_round_robin(unmatched: DataFrame, preferred: Sequence[str], order: str = "id") -> DataFrame:
    """(id, section_id): chunks in order dealt to preferred sections in turn. They are numbered task by task, staged in order."""
    if not preferred:
        return unmatched.select("id", F.lit(None).cast("string").alias("section_id")).limit(0)
    numbered = summed(unmatched.select("id", F.col(order).alias("order")), [F.asc("order"), F.asc("id")], "turns")
    turn = (F.col("row") % len(preferred) + 1).cast("int")
    return numbered.select("id", F.element_at(F.array(*map(F.lit, preferred)), turn).alias("section_id"))


def route_heuristic(chunks: DataFrame) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("name", "file_path", "package", "description"))))
    return chunks.select("id", section_by_heuristic(text).alias("section_id"))


def section_order(affected: DataFrame, preferred: Sequence[str] = ()) -> DataFrame:
    """affected (section_id, n) with pos: preferred sections first in their order, then by n and id. A row for each section, in one task."""
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col("section_id")) if preferred else F.lit(0)
    at = F.when(at > 0, at)
    return affected.withColumn("pos", F.row_number().over(Window.orderBy(at.asc_nulls_last(), F.desc("n"), "section_id")))


def route_by_choice(chunks: DataFrame, sections: Sequence[str], choose: Callable[[Sequence[str], str], int], most: int = 2) -> DataFrame:
    """(id, section_id) of the first ``most`` chunks that a service finds a section for: choose(sections, text) is a position or -1."""
    first = chunks.orderBy("id").limit(most).select("id", F.concat_ws("\n", "name", "file_path", "description").alias("text")).collect()
    found = [(r.id, sections[at]) for r in first if 0 <= (at := choose(sections, r.text)) < len(sections)]
    return chunks.sparkSession.createDataFrame(found, "id string, section_id string")


def route_cascade(chunks: DataFrame, section_files: DataFrame, preferred: Sequence[str] = (), heuristic: bool = True, sections: DataFrame | None = None, new_section: str = "updates", most_new: int = 8, chosen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, section_id, stage): each stage takes what the one before left, so stages partition the chunks.

    by file, then preferred sections in turn, the heuristic, what ``chosen`` makes of the rest (id, section_id), the
    nearest section by vector (chunks with ``embedding``), and a new section of ``most_new`` chunks.
    """
    matched, rest = route_by_file(chunks, section_files)
    out = matched.withColumn("stage", F.lit("file"))
    if preferred:
        out = out.unionByName(route_round_robin(rest, preferred).withColumn("stage", F.lit("preferred")))
        return out
    if heuristic:
        return out.unionByName(route_heuristic(rest).withColumn("stage", F.lit("heuristic")))
    if chosen is not None:
        picked = chosen(rest)
        out = out.unionByName(picked.select("id", "section_id", F.lit("choice").alias("stage")))
        rest = rest.join(picked.select("id"), "id", "left_anti")
    if sections is not None:
        near = stage(assign(rest, sections).select("id", "section_id"), "near")  # it is read twice; cosines are computed once
        out = out.unionByName(near.withColumn("stage", F.lit("semantic")))
        rest = rest.join(near, "id", "left_anti")
    return out.unionByName(rest.orderBy("id").limit(most_new).select("id", F.lit(new_section).alias("section_id"), F.lit("new").alias("stage")))
