"""Texts of many sections in one plan: claims from their evidence, drafts, plain listings, diagrams, and how all these read.

Evidence are chunks with ``section``, which is unique, and ``section_id``, which decides by what rules a section is written. Rules
differ between four kinds of sections, so a plan is a union of four parts, however many sections and documents there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import exprs
from weftline.operators import capability, diagrams, docmodel, report, retrieval
from weftline.staging import stage

BY = ("section",)
#: Sections with rules of their own; the last kind is all others.
KINDS = (*capability.DRAFTS, "key-features", "")
LISTED, FEATURES = 8, 5


def _kind(kind: str) -> Column:
    return F.col("section_id") == kind if kind else ~F.col("section_id").isin(*KINDS[:-1])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def claims_each(evidence: DataFrame) -> DataFrame:
    """(section, claim_id, ord, text, confidence, sources) of each section; evidence has cleaned sources."""
    return _union([
        capability.feature_claims(evidence.filter(_kind(k)), by=BY) if k == "key-features" else capability.draft_claims(evidence.filter(_kind(k)), k, BY)
        for k in KINDS
    ])


def drafts_each(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, draft) of sections that have claims and none with a problem; sections: section, section_id, title."""
    bad = capability.claim_problems(claims, BY).select("section").distinct()
    good = claims.join(bad, "section", "left_anti").join(sections.select("section", "section_id", "title"), "section")
    parts = [capability.draft_markdown(good.filter(_kind(k)), k, "title", BY) for k in KINDS]
    return _union(parts).withColumnRenamed("markdown", "draft")


def listings_each(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, listing): what a section says without a draft; sections: section, section_id, title, goal."""
    features = capability.key_features_markdown(evidence.filter(_kind("key-features")), FEATURES, BY)
    first = retrieval.first_semantic(evidence.filter(~_kind("key-features")), LISTED, BY)
    text = exprs.paragraph(exprs.claim_text(F.col("name"), F.col("package"), F.col("description")))
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("**: "), text, F.lit("\n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "name", line.alias("line")))), lambda x: x["line"])
    told = first.groupBy("section").agg(F.array_join(lines, "").alias("lines"))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("goal"), F.lit("\n\n"))
    both = sections.join(features, "section", "left").join(told, "section", "left")
    listing = F.when(_kind("key-features"), F.coalesce("markdown", F.lit(capability.NO_FEATURES))).otherwise(F.concat(head, F.coalesce("lines", F.lit(""))))
    return both.select("section", listing.alias("listing"))


def diagrams_each(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, diagram) of sections with a heading for one: stages for the overview, else packages; without evidence an empty one."""
    drawn = sections.filter("heading <> ''").select("section", "section_id")
    rows = evidence.join(drawn.select("section"), "section", "left_semi")
    overview = _kind("overview")
    made = diagrams.architecture_flow(rows.filter(overview), BY).unionByName(diagrams.architecture_snapshot(rows.filter(~overview), BY))
    none = F.when(overview, "```mermaid\ngraph TD\n```\n").otherwise("```mermaid\ngraph LR\n```\n")
    return drawn.join(made, "section", "left").select("section", F.coalesce("diagram", none).alias("diagram"))


def read(texts: DataFrame) -> DataFrame:
    """texts (section_id, plain, heading, diagram) with content, quality, issues, low, and noted, which tells that evidence is limited."""
    drawn = (F.coalesce("heading", F.lit("")) != "") & (F.coalesce("diagram", F.lit("")) != "")
    content = F.when(drawn, diagrams.with_diagram(F.col("plain"), F.col("heading"), F.col("diagram"))).otherwise(F.col("plain"))
    judged = report.writer_quality(texts.withColumn("content", content))
    return judged.withColumn("low", report.is_low_quality(F.col("section_id"), F.col("content"))).withColumn("noted", exprs.with_low_evidence_note(F.col("content")))


def texts(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """A row for the draft of each section, where it has one (choice 0), and one for its listing (choice 1), as ``read`` tells.

    sections: section, section_id, title, goal, heading (of a diagram, or empty).
    """
    cleaned = docmodel.chunk_sources(evidence)
    claims = stage(claims_each(cleaned), "claims")
    wide = sections.join(drafts_each(claims, sections), "section", "left").join(listings_each(cleaned, sections), "section")
    wide = stage(wide.join(diagrams_each(cleaned, sections), "section", "left"), "texts")
    each = F.posexplode(F.array("draft", "listing")).alias("choice", "plain")
    return read(wide.select("section", "section_id", "heading", "diagram", each).filter("plain IS NOT NULL"))


def is_good() -> Column:
    """A draft is taken if it reads well; a listing always."""
    return (F.col("choice") == 1) | (~F.col("low") & (F.col("quality") >= report.QUALITY_LOW))


def best(read_texts: DataFrame) -> DataFrame:
    """One row of ``texts`` for each section: its draft, if good, else its listing."""
    row = F.struct(*(c for c in read_texts.columns if c != "section"))
    return read_texts.filter(is_good()).groupBy("section").agg(F.min_by(row, "choice").alias("r")).select("section", "r.*")
