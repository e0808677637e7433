"""Document model: Markdown to sections, repair, validation, sources, and Markdown again.

docs: doc, content. sections: doc, id, title, level, ord, parent_id, content_md, summary, status, sources, hash.
A document's sections meet in one group; documents spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import blank, clamp, section_hash, slug, summary, title_of, trim_ws
from weftline.operators.planning import CANONICAL
from weftline.staging import stage

SOURCE = "struct<symbol_id:string,file_path:string,start_line:int,end_line:int,relation:string,confidence:double>"
STATUSES = ("active", "deprecated", "archived")
RELATIONS = ("primary", "dependency", "context")


def split_markdown(docs: DataFrame, fence_aware: bool = False) -> DataFrame:
    """doc, ord, id, title, level, content: a section for each header of 1 to 6 ``#``, and Introduction before the first.

    Headers inside code fences split too, unless ``fence_aware``. Null and empty documents have no sections.
    """
    text = F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), "\n$", "")
    lines = docs.filter(F.coalesce("content", F.lit("")) != "").select("doc", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    far = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("t", trim_ws(F.col("line")))
    header = F.col("t").rlike("^#{1,6} ") | F.col("t").rlike("^#{1,6}\t$")
    if fence_aware:
        fences = F.sum(F.col("t").startswith("```").cast("int")).over(far)
        header = header & (fences % 2 == 0)
    lines = lines.withColumn("h", header.cast("int")).withColumn("ord", F.sum("h").over(far))
    title = F.max(F.when(F.col("h") == 1, F.struct(trim_ws(F.regexp_replace("t", "^#{1,6}", "")).alias("title"), F.length(F.regexp_extract("t", "^#+", 0)).alias("level")))).alias("head")
    body = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("content")
    s = lines.groupBy("doc", "ord").agg(title, body)
    s = s.select("doc", "ord", F.coalesce("head.title", F.lit("Introduction")).alias("title"), F.coalesce("head.level", F.lit(0)).alias("level"), "content")
    return s.withColumn("id", F.sha2(F.concat_ws(":", "doc", "title"), 256))


def dedup_slugs(rows: DataFrame, base: str, order: str, by: Sequence[str] = ("doc",)) -> DataFrame:
    """rows with ``id``: the base, and from its second occurrence in a document on with its number."""
    n = F.row_number().over(Window.partitionBy(*by, base).orderBy(order))
    return rows.withColumn("id", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string"))))


def build_model(docs: DataFrame, fence_aware: bool = False) -> DataFrame:
    """Sections of a model from Markdown; a document without any gets an overview."""
    s = split_markdown(docs, fence_aware).drop("id").withColumn("base", slug(F.col("title")))
    s = dedup_slugs(s, "base", "ord").withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("ord")) - 1)
    none = F.array().cast(f"array<{SOURCE}>")
    s = s.select(
        "doc", "id", "title", F.greatest("level", F.lit(1)).alias("level"), "ord", F.lit(None).cast("string").alias("parent_id"), trim_ws(F.col("content")).alias("content_md"),
        summary(F.col("content")).alias("summary"), F.lit("active").alias("status"), none.alias("sources"), section_hash(F.col("title"), F.col("content")).alias("hash"),
    )
    empty = docs.groupBy("doc").agg(F.max(F.coalesce("content", F.lit("")) != "").alias("_some")).filter("NOT _some")
    stub = empty.select("doc", *(F.lit(v).cast(t).alias(c) for c, v, t in (("id", "overview", "string"), ("title", "Overview", "string"), ("level", 1, "int"), ("ord", 0, "int"), ("parent_id", None, "string"), ("content_md", "# Overview\n", "string"), ("summary", "", "string"), ("status", "active", "string"))), none.alias("sources"), F.lit("sha256:empty").alias("hash"))
    return s.unionByName(stub)


def rank_of(id_: Column, order: Sequence[str] = CANONICAL) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), id_)
    return F.when(at > 0, at - 1).otherwise(len(order) + 1)


def reindex(sections: DataFrame) -> DataFrame:
    """Order 0, 1, ...: canonical sections first, then as before."""
    return sections.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy(rank_of(F.col("id")), "ord", "id")) - 1)


def normalize(sections: DataFrame) -> DataFrame:
    """Adds missing canonical sections, orders, and repairs levels, titles, headings, summaries and hashes. Sections are staged, so their texts are read once, whoever asks for ids."""
    spark = sections.sparkSession
    sections = stage(sections, "sections")
    wanted = sections.select("doc").distinct().crossJoin(F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(CANONICAL)], "id string, pos int")))
    end = sections.groupBy("doc").agg(F.max("ord").alias("last"))
    missing = wanted.join(sections.select("doc", "id"), ["doc", "id"], "left_anti").join(end, "doc").select("doc", "id", title_of(F.col("id")).alias("title"), F.lit(1).alias("level"), (F.col("last") + 1 + F.col("pos")).alias("ord"), F.lit("active").alias("status"), F.array().cast(f"array<{SOURCE}>").alias("sources"))
    s = reindex(sections.unionByName(missing, allowMissingColumns=True))
    s = s.withColumn("level", F.when(F.col("level").between(1, 6), F.col("level")).otherwise(2)).withColumn("title", F.when(F.coalesce("title", F.lit("")) == "", title_of(F.col("id"))).otherwise(F.col("title")))
    body, head = trim_ws(F.coalesce("content_md", F.lit(""))), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"))
    rest = F.when(F.instr(body, "\n") > 0, F.substr(F.col("trim_body"), F.instr("trim_body", "\n"))).otherwise("")
    s = s.withColumn("trim_body", body)
    content = F.when(body == "", F.concat(head, F.lit("\n\nTBD."))).when(body.startswith("#"), F.concat(head, rest)).otherwise(F.concat(head, F.lit("\n\n"), body))
    s = s.withColumn("content_md", content).drop("trim_body")
    return s.withColumn("summary", summary(F.col("content_md"))).withColumn("hash", section_hash(F.col("title"), F.col("content_md"), F.col("sources")))


def violations(sections: DataFrame, required: Sequence[str] = CANONICAL) -> DataFrame:
    """(doc, problem, id): blank and repeated ids, required sections that are missing, unknown status or source relation, confidences outside 0 to 1."""
    row = lambda df, problem: df.select("doc", F.lit(problem).alias("problem"), "id")
    sections = stage(sections.select("doc", "id", "status", "sources"), "sections")
    repeated = sections.groupBy("doc", "id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spark = sections.sparkSession
    wanted = sections.select("doc").distinct().crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in required], "id string")))
    source = F.exists("sources", lambda s: ~s["relation"].isin(*RELATIONS) | ~s["confidence"].between(0.0, 1.0))
    out = row(sections.filter(F.coalesce("id", F.lit("")) == ""), "blank id").unionByName(row(repeated, "repeated id"))
    out = out.unionByName(row(wanted.join(sections.select("doc", "id"), ["doc", "id"], "left_anti"), "required section missing"))
    out = out.unionByName(row(sections.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "unknown status"))
    return out.unionByName(row(sections.filter(F.coalesce(source, F.lit(False))), "bad source"))


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """chunks with ``sources`` cleaned: without blank ids or files, lines 1 at least, known relations, confidences 0 to 1; without any, the chunk itself."""
    fixed = F.transform(
        F.filter("sources", lambda s: ~blank(s["symbol_id"]) & ~blank(s["file_path"])),
        lambda s: F.struct(
            trim_ws(s["symbol_id"]).alias("symbol_id"), trim_ws(s["file_path"]).alias("file_path"), F.greatest(s["start_line"], F.lit(1)).cast("int").alias("start_line"), F.greatest(s["end_line"], F.lit(1)).cast("int").alias("end_line"),
            F.when(F.lower(trim_ws(s["relation"])).isin(*RELATIONS), F.lower(trim_ws(s["relation"]))).otherwise("primary").alias("relation"), clamp(F.coalesce(s["confidence"], F.lit(0.0)), 0.0, 1.0).alias("confidence"),
        ),
    )
    own = F.array(F.struct(F.col("id").alias("symbol_id"), F.when(blank(F.col("file_path")), F.col("id")).otherwise(F.col("file_path")).alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("primary").alias("relation"), F.lit(0.9).alias("confidence")))
    return chunks.withColumn("sources", F.when(F.coalesce(F.size(fixed), F.lit(0)) > 0, fixed).otherwise(own))


def merge_sources(existing: DataFrame, new: DataFrame, by: Sequence[str] = ("section_id",)) -> DataFrame:
    """Rows of existing, all of them, and the first of new rows (pos) for each symbol and file that existing has not."""
    key = [*by, "symbol_id", "file_path"]
    first = new.join(existing.select(*key).distinct(), key, "left_anti").withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("pos"))).filter("_rn = 1").drop("_rn")
    return existing.withColumn("pos", F.col("pos").cast("long")).withColumn("added", F.lit(False)).unionByName(first.withColumn("pos", F.col("pos").cast("long")).withColumn("added", F.lit(True)), allowMissingColumns=True)


def render(sections: DataFrame, title: str = "Project Documentation") -> DataFrame:
    """(doc, markdown) of normalised sections in order."""
    s = sections.withColumn("body", trim_ws(F.coalesce("content_md", F.lit("")))).filter("body <> ''")
    head = F.when(F.col("body").startswith("#"), F.col("body")).otherwise(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title"), F.lit("\n\n"), F.col("body")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "id", head.alias("text")))), lambda x: x["text"])
    return s.groupBy("doc").agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(parts, "\n\n"), F.lit("\n")).alias("markdown"))
