"""Quality of written sections, and the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.exprs import contains_any, hits, trim_ws

# Words that tell a walk through files, and words left by a prompt.
WALKTHROUGH = ("module `", ".go`", ".go ", "package `", "containing:")
PLACEHOLDERS = ("explain the", "describe the", "write ", "must include", "tbd", "placeholder")
SEVERITIES = ("critical", "warning", "info")
HEURISTIC_SHARE, QUALITY_LOW, FALLBACK_BELOW = 0.8, 0.55, 0.45


def quality_issues() -> dict[str, tuple[Column, float]]:
    """Each issue's test and penalty, over the columns that ``_measured`` adds."""
    section, low, bullets = F.col("_section"), F.col("_low"), F.col("_bullets")
    feature = section == "key-features"
    return {
        "list_heavy": ((F.col("_lines") > 0) & (bullets / F.greatest("_lines", F.lit(1)) > 0.45), 0.25),
        "insufficient_paragraphs": (F.col("_paragraphs") < 2, 0.2),
        "file_walkthrough_style": (hits(low, WALKTHROUGH) >= 2, 0.35),
        "instructional_or_placeholder_text": (contains_any(low, PLACEHOLDERS), 0.2),
        "missing_overview_diagram": ((section == "overview") & ~F.contains(low, F.lit("```mermaid")), 0.2),
        "insufficient_feature_sections": (feature & (F.col("_heads") < 2), 0.2),
        "missing_technical_anchors": (feature & ~F.contains(low, F.lit("`")), 0.15),
    }


def _measured(sections: DataFrame, section: str, content: str) -> DataFrame:
    """sections with text and counts as columns of their own, so that no test computes them again."""
    bullet = lambda x: x.startswith("- ") | x.startswith("* ")
    s = sections.withColumn("_section", F.col(section)).withColumn("_text", trim_ws(F.coalesce(F.col(content), F.lit(""))))
    s = s.withColumn("_low", F.lower("_text")).withColumn("_split", F.filter(F.transform(F.split("_text", "\n"), trim_ws), lambda x: x != ""))
    s = s.withColumn("_bullets", F.size(F.filter("_split", bullet))).withColumn("_paragraphs", F.size(F.filter("_split", lambda x: ~bullet(x) & ~x.startswith("#"))))
    return s.withColumn("_lines", F.size("_split")).withColumn("_heads", F.size(F.split("_low", "\n## ")) - 1)


def writer_quality(sections: DataFrame, section: str = "section_id", content: str = "content") -> DataFrame:
    """sections with quality (0 to 1) and issues, listed with commas."""
    tests = quality_issues()
    s = _measured(sections, section, content).withColumn("_issues", F.array(*(test for test, _ in tests.values())))
    lost = F.lit(0.0)
    for i, (_, penalty) in enumerate(tests.values()):
        lost = lost + F.when(F.col("_issues")[i], penalty).otherwise(0.0)
    names = F.concat_ws(",", *(F.when(F.col("_issues")[i], name) for i, name in enumerate(tests)))
    empty = F.col("_text") == ""
    s = s.withColumn("quality", F.when(empty, 0.0).otherwise(F.round(F.greatest(1 - lost, F.lit(0.0)), 6))).withColumn("issues", F.when(empty, "empty_content").otherwise(names))
    return s.select(*sections.columns, "quality", "issues")


def is_low_quality(section: Column, content: Column) -> Column:
    low = F.lower(trim_ws(content))
    heads = F.size(F.split(low, "\n## ")) - 1
    bad = (low == "") | contains_any(low, ["## capability 1", "## capability 2", "m u s t include", "write 3-5 feature"])
    return F.coalesce(bad | ((section == "overview") & ~F.contains(low, F.lit("```mermaid"))) | ((section == "key-features") & ((heads < 2) | F.contains(low, F.lit(".go")))), F.lit(True))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "warning", 2).otherwise(1)


def by_signal() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.asc("stage"), F.asc("code")]


def signal_counts(signals: DataFrame) -> DataFrame:
    """(severity, n); the three known severities always, others where they occur."""
    known = signals.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    n = signals.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "severity", "full_outer").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def summary(stages: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: stage_count, failed_stages, section_count, low_evidence_sections, avg_quality."""
    a = stages.agg(F.count(F.lit(1)).alias("stage_count"), F.count_if(F.col("status") != "ok").alias("failed_stages"))
    b = sections.agg(F.count(F.lit(1)).alias("section_count"), F.count_if(F.col("low_evidence")).alias("low_evidence_sections"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("avg_quality"))
    return a.crossJoin(b)


def section_signals(sections: DataFrame) -> DataFrame:
    """(stage, code, severity, section_id) from sections: section_id, low_evidence, search_hits, heuristic_hits, quality."""
    total = F.col("search_hits") + F.col("heuristic_hits")
    rules = (
        ("low_evidence_section", "warning", F.col("low_evidence")), ("semantic_hits_zero", "warning", F.col("search_hits") == 0),
        ("heuristic_dominant", "info", (total > 0) & (F.col("heuristic_hits") / F.greatest(total, F.lit(1)) >= HEURISTIC_SHARE)), ("writer_quality_low", "warning", F.col("quality") < QUALITY_LOW),
    )
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, test in rules)))
    return sections.select("section_id", F.explode(found).alias("s")).select(F.lit("generate").alias("stage"), "s.code", "s.severity", "section_id")
