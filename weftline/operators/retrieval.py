"""Evidence for sections: keyword and vector hits, their union, filters, diversity, and statistics.

``search_each`` and ``select_each`` serve any number of sections of any number of documents in one plan; a section of one
document is a table of one row. Sections have a unique ``section``, and ``section_id``, which decides by what rules it is filled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import CODE_TYPES, blank, file_key, hits, is_testlike, richness
from weftline.operators.order import first_rows, summed
from weftline.operators.vector import blocks, top_k_each
from weftline.staging import stage

# Section plans (id, title, goal, required blocks, query hints, keywords, top_k, min_evidence, uses a writer).
SECTION_KEYWORDS = {
    "overview": "architecture system component module entry flow interface".split(),
    "key-features": "feature service workflow domain policy validation resolver".split(),
    "development": "config env cli command test build deploy".split(),
}
SECTION_TOP_K = {"overview": (16, 6, False), "key-features": (20, 8, True), "development": (14, 5, False)}
FALLBACK_TOP_K = (12, 4)
FLOW_WORDS = "flow pipeline sequence before after when then route".split()
#: Rows of hits that are broadcast to meet their chunks, rather than shuffling these; counted.
FEW_HITS = 200_000
LAYER_A, LAYER_B, BLOCK_LINES, MIN_FLOW, CONTEXT_LINES = 8, 4, 60, 2, 4


def keyword_text() -> Column:
    return F.lower(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in ("name", "description", "signature", "content"))))


def with_behaviour() -> Column:
    return F.when(F.col("unit_type").isin(*CODE_TYPES, "file_module"), 1).otherwise(0)


def keyword_score(words: Sequence[str]) -> Column:
    """3 for each word found in name, description, signature or content; 1 for a unit with behaviour."""
    return hits(keyword_text(), [w.strip().lower() for w in words if w.strip()], 3) + with_behaviour()


def keyword_top_k(chunks: DataFrame, words: Sequence[str], limit: int) -> DataFrame:
    """Chunks of positive score by score and id; if there are none, the first by id."""
    scored = chunks.withColumn("score", keyword_score(words)).withColumn("miss", (F.col("score") <= 0).cast("int"))
    first = scored.orderBy("miss", F.desc("score"), "id").limit(limit)
    return first.withColumn("least", F.min("miss").over(Window.partitionBy())).filter("miss = least").drop("miss", "least")


def merge_ranked(groups: Sequence[DataFrame], limit: int = 0, pos: str = "pos") -> DataFrame:
    """Union of ranked lists in order of (list, pos), each id once, without blank ids; ``pos`` is renumbered. Without a limit, task by task, staged in order."""
    union = None
    for i, g in enumerate(groups):
        g = g.withColumn("_list", F.lit(i))
        union = g if union is None else union.unionByName(g, allowMissingColumns=True)
    once = union.filter(~blank(F.col("id"))).withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("_list", pos))).filter("_rn = 1")
    if limit <= 0:
        return summed(once, [F.asc("_list"), F.asc(pos), F.asc("id")], "merged").withColumn(pos, (F.col("row") + 1).cast("int")).drop("_list", "_rn", "row")
    ranked = once.orderBy("_list", pos, "id").limit(limit)
    return ranked.withColumn(pos, F.row_number().over(Window.orderBy("_list", pos, "id"))).drop("_list", "_rn")


def section_filter(section: Column) -> Column:
    """What a section leaves out: values (and for key features files), and tests."""
    kind, test = F.col("unit_type"), is_testlike(F.col("name"))
    value = kind.isin("constant", "variable")
    return F.when(section == "key-features", ~value & (kind != "file_module") & ~test).when(section == "overview", ~value).when(section == "development", ~test).otherwise(True)


def filter_or_all(rows: DataFrame, keep: Column, by: Sequence[str] = ()) -> DataFrame:
    """Rows that keep, by group; all rows of a group where none does. The groups with any are joined, so no group meets in a task."""
    if not by:
        any_ = rows.agg(F.coalesce(F.bool_or(keep), F.lit(False)).alias("_any"))
        return rows.crossJoin(F.broadcast(any_)).filter(keep | ~F.col("_any")).drop("_any")
    any_ = rows.groupBy(*by).agg(F.bool_or(keep).alias("_any"))
    return rows.join(any_, list(by)).filter(keep | ~F.col("_any")).select(rows.columns)


def _is_semantic() -> Column:
    return ~F.col("unit_type").isin("file_module", "symbol_segment")


def semantic_only(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return filter_or_all(chunks, _is_semantic(), by)


def diversity_rerank(chunks: DataFrame, limit: int | Column, per_file: int = 2, by: Sequence[str] = (), pos: str = "pos") -> DataFrame:
    """At most ``limit`` rows of each list (``by``): first in order with at most ``per_file`` of a file, then the rest by richness and id; ``rank`` is the new order.

    Lists are search results: their own limits bound the windows here. Richness is told before the windows, so that texts nobody asks
    for pass none; chunks may bring it as ``_rich``.
    """
    per_file = per_file if per_file > 0 else 2
    every = Window.partitionBy(*by)
    in_file = F.row_number().over(Window.partitionBy(*by, "_file").orderBy(pos))
    c = chunks if "_rich" in chunks.columns else chunks.withColumn("_rich", richness())
    c = c.withColumn("_file", file_key(F.col("file_path"), F.col("id"))).withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_in", in_file)
    all_fit = F.col("_n") <= limit if isinstance(limit, Column) or limit > 0 else F.lit(True)
    later = ~all_fit & (F.col("_in") > per_file)
    order = [later.cast("int"), F.when(later, -F.col("_rich")), F.when(later, F.col("id")), F.col(pos)]
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(all_fit | (F.col("rank") <= limit)).drop("_file", "_n", "_in", "_rich")


def evidence_stats(chunks: DataFrame, by: Sequence[str], min_evidence: Column, queries: Column) -> DataFrame:
    """coverage, confidence, chunk_count, source_count, query_count, low_evidence of each group of chunks.

    Confidence is the mean of positive source confidences (0.55 without any) plus a fifth of files per chunk, at most 1.
    """
    c = chunks.withColumn("_file", file_key(F.col("file_path"), F.col("id"))).withColumn("_conf", F.filter(F.transform("sources", lambda s: s["confidence"]), lambda x: x > 0))
    total = F.aggregate("_conf", F.lit(0.0).cast("double"), lambda s, x: s + x)
    g = c.withColumn("_sum", total).groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("_file").alias("files"), F.sum(F.size("sources")).alias("source_count"), F.sum("_sum").alias("s"), F.sum(F.size("_conf")).alias("k"), F.max(min_evidence).alias("least"), F.max(queries).alias("query_count")
    )
    coverage = F.least(F.lit(1.0), F.col("chunk_count") / F.greatest(F.lit(1), F.col("least")))
    confidence = F.least(F.lit(1.0), F.when(F.col("k") > 0, F.col("s") / F.col("k")).otherwise(0.55) + 0.2 * F.col("files") / F.col("chunk_count"))
    g = g.withColumns({"coverage": F.round(coverage, 6), "confidence": F.round(confidence, 6)})
    return g.withColumn("low_evidence", (F.col("coverage") < 0.7) | (F.col("confidence") < 0.6)).select(*by, "coverage", "confidence", "chunk_count", "source_count", "query_count", "low_evidence")


def distinct_queries(queries: DataFrame, text: str = "query", pos: str = "pos") -> DataFrame:
    """Queries that differ after lower-casing and joining of white space; the first of each, without blank ones."""
    key = F.lower(F.regexp_replace(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), r"\s+", " "))
    return queries.withColumn("_key", key).filter("_key <> ''").groupBy("_key").agg(F.min_by(F.struct(*queries.columns), pos).alias("q")).select("q.*")


def section_queries(section: str, title: str, goal: str, blocks: Sequence[str], hints: Sequence[str], capabilities: Sequence[tuple[str, str]]) -> list[str]:
    """Queries of a section: its plan's words, its goal, its blocks, and the titles and intents of four capabilities."""
    out = [" ".join(x for x in (title, goal, *hints) if x), goal, *(f"{section} {b.strip()}" for b in blocks if b.strip())]
    for name, intent in capabilities[:4]:
        out += [f"{section} capability {name}" if name.strip() else "", intent]
    seen: dict[str, str] = {}
    for q in out:
        seen.setdefault(" ".join(q.lower().split()), q)
    seen.pop("", None)
    return list(seen.values())


def per_query_k(top_k: int, queries: int) -> int:
    return top_k if queries <= 1 else max(min(top_k // queries, top_k), min(4, top_k))


def shares(queries: DataFrame, sections: DataFrame) -> DataFrame:
    """queries (section, n, query) with ``each``: the hits that a query may bring, as ``per_query_k`` tells."""
    asked = queries.groupBy("section").agg(F.count(F.lit(1)).alias("_asked")).join(sections.select("section", "top_k"), "section")
    each = F.greatest(F.least((F.col("top_k") / F.col("_asked")).cast("int"), F.col("top_k")), F.least(F.lit(4), F.col("top_k")))
    each = F.when(F.col("_asked") <= 1, F.col("top_k")).otherwise(each)
    return queries.join(asked.select("section", each.alias("each")), "section")


def search_each(vectors: DataFrame, queries: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, id, pos): what each section's queries find, in the order of queries (n, from 0) and then of nearness; each id once.

    vectors: id, embedding; queries: section, n, query; sections: section, top_k. All queries of all sections are one search.
    """
    asked = stage(shares(queries, sections).select(F.struct("section", "n", "each").alias("query_id"), "query"), "asked")
    widest = asked.agg(F.max("query_id.each")).first()[0] or 0
    hits_ = top_k_each(vectors, asked, widest).filter(F.col("rank") <= F.col("query_id.each"))
    pos = F.col("query_id.n") * F.col("query_id.each") + F.col("rank")
    return hits_.groupBy(F.col("query_id.section").alias("section"), "id").agg(F.min(pos).alias("pos"))


def keyword_top_k_each(chunks: DataFrame, sections: DataFrame, widest: int) -> DataFrame:
    """(section, id, pos) of ``keyword_top_k`` for each of the sections (section, top_k, words); top_k is ``widest`` at most.

    Sections that ask for the same words share one list, so texts are searched once for each list of words, not for each section. Lists
    are broadcast in blocks; a task's rows are cut to ``widest`` of a list before they are shuffled, and hold ids and scores only.
    """
    rank = F.row_number().over(Window.partitionBy("words").orderBy("miss", F.desc("score"), "id"))
    narrow = chunks.select("id", keyword_text().alias("_text"), with_behaviour().alias("_kind"))
    clean = F.filter(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.lower(F.trim(w))), lambda w: w != "")
    asked = stage(sections.select("section", "top_k", F.array_sort(clean).alias("words")), "asked")
    found = None
    for part in blocks(asked.groupBy("words").agg(F.max("top_k").alias("top_k")), "words"):
        held = F.size(F.filter("words", lambda w: F.contains(F.col("_text"), w)))
        score = 3 * held + F.col("_kind")
        scored = narrow.crossJoin(F.broadcast(part)).select("words", "top_k", "id", score.alias("score"))
        scored = scored.withColumn("miss", (F.col("score") <= 0).cast("int")).withColumn("pos", rank)
        top = scored.filter((F.col("pos") <= widest) & (F.col("pos") <= F.col("top_k"))).drop("top_k")
        found = top if found is None else found.unionByName(top)
    best = stage(found.withColumn("least", F.min("miss").over(Window.partitionBy("words"))).filter("miss = least"), "words")
    return asked.join(best, "words").filter(F.col("pos") <= F.col("top_k")).select("section", "id", "pos")


def _meet(hits_: DataFrame, chunks: DataFrame) -> DataFrame:
    """Staged hits with their chunks: few hits are broadcast, so that texts stay where they are."""
    return chunks.join(F.broadcast(hits_) if hits_.limit(FEW_HITS + 1).count() <= FEW_HITS else hits_, "id")


def select_each(chunks: DataFrame, hits_: DataFrame, sections: DataFrame) -> DataFrame:
    """Evidence of each section: chunks with section, section_id, top_k, pos and rank.

    hits_: section, id, pos (``search_each``); sections: section, section_id, top_k, words. As for one section: hits up to twice top_k,
    the section's filter or all where it leaves none, keyword hits where hits are under half of top_k, diversity. Only sections that
    want keyword hits are scored against chunks. Ids are unique in chunks, which have none of these columns. Windows are of one
    section, whose rows its top_k bounds.
    """
    plan = sections.select("section", "section_id", "top_k")
    keep, in_section = section_filter(F.col("section_id")), Window.partitionBy("section")
    widest = sections.agg(F.max("top_k")).first()[0] or 0
    once = hits_.filter(~blank(F.col("id"))).groupBy("section", "id").agg(F.min("pos").alias("pos")).join(plan, "section")
    once = once.withColumn("pos", F.row_number().over(in_section.orderBy("pos", "id")))
    first = stage(once.filter((F.col("pos") <= 2 * widest) & (F.col("pos") <= 2 * F.col("top_k"))), "hits")
    found = stage(filter_or_all(_meet(first, chunks), keep, ("section",)), "found")
    counted = found.groupBy("section").agg(F.count(F.lit(1)).alias("_found"))
    short = F.coalesce("_found", F.lit(0)) < F.expr("top_k div 2")
    wanting = stage(sections.join(counted, "section", "left").filter(short).select("section", "top_k", "words"), "wanting")
    words = stage(keyword_top_k_each(chunks, wanting, widest).join(plan, "section"), "words")
    extra = filter_or_all(_meet(words, chunks), keep, ("section",))
    both = found.withColumn("_list", F.lit(0)).unionByName(extra.withColumn("_list", F.lit(1)))
    both = both.withColumn("_rn", F.row_number().over(Window.partitionBy("section", "id").orderBy("_list", "pos"))).filter("_rn = 1").drop("_rn")
    both = both.withColumn("pos", F.row_number().over(in_section.orderBy("_list", "pos", "id")))
    both = both.withColumn("_found", F.count_if(F.col("_list") == 0).over(in_section))
    most = F.when(short, F.col("top_k")).otherwise(2 * F.col("top_k"))
    return diversity_rerank(both.filter(F.col("pos") <= most).drop("_list", "_found"), F.col("top_k"), 2, ("section",))


def select_evidence(chunks: DataFrame, ranked: DataFrame, section: str, top_k: int, words: Sequence[str]) -> DataFrame:
    """``select_each`` of one section from the hits of its queries (ranked: id, pos)."""
    one = chunks.sparkSession.createDataFrame([(section, section, top_k, list(words))], "section string, section_id string, top_k int, words array<string>")
    found = select_each(chunks, ranked.select(F.lit(section).alias("section"), "id", "pos"), one)
    return found.select(*chunks.columns, "pos", "rank")


def first_by_name(chunks: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    return first_rows(chunks, [F.asc("id"), F.asc("name")], n, by) if n > 0 else chunks


def first_semantic(chunks: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """The n first by name of ``semantic_only``: each task cuts its rows, semantic ones first, before groups meet."""
    return semantic_only(first_rows(chunks, [F.when(_is_semantic(), 0).otherwise(1), F.asc("id"), F.asc("name")], n, by), by)


def claim_weight(text: Column, confidence: Column) -> Column:
    """3 for a confidence under 0.75 and 2 for each word of flow... a claim of more weight gets its source lines first."""
    return F.when(confidence < 0.75, 3).otherwise(0) + hits(F.lower(text), FLOW_WORDS, 2)


def is_flow(text: Column) -> Column:
    return hits(F.lower(text), FLOW_WORDS, 1) > 0


def hydrate(claims: DataFrame, lines: DataFrame, context: int = CONTEXT_LINES, most: int = BLOCK_LINES) -> DataFrame:
    """Source lines of claims with ``context`` lines around, ``most`` at most. claims: claim_id, text, confidence, src_ord, symbol_id, file_path, start_line, end_line; lines: path, line_no, text."""
    sizes = lines.groupBy(F.col("path").alias("file_path")).agg(F.max("line_no").alias("_n"))
    spans = claims.filter(~blank(F.col("file_path"))).join(sizes, "file_path").withColumn("from_line", F.greatest(F.col("start_line") - context, F.lit(1))).withColumn("to_line", F.least(F.col("end_line") + context, F.col("_n")))
    spans = spans.withColumn("to_line", F.least("to_line", F.col("from_line") + most - 1)).filter("to_line >= from_line")
    wanted = spans.select("claim_id", "src_ord", "text", "confidence", "symbol_id", "file_path", "start_line", "end_line", "from_line", "to_line", F.explode(F.sequence("from_line", "to_line")).alias("line_no"))
    at = wanted.join(lines.select(F.col("path").alias("file_path"), "line_no", F.col("text").alias("line")), ["file_path", "line_no"])
    g = at.groupBy("claim_id", "src_ord", "text", "confidence", "symbol_id", "file_path", "start_line", "end_line", "from_line", "to_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return g.withColumn("id", F.concat(F.lit("evidence:"), F.col("symbol_id"), F.lit(":"), F.col("from_line"), F.lit("-"), F.col("to_line"))).withColumn("unit_type", F.lit("evidence_block"))


def layer_b(blocks: DataFrame, most: int = LAYER_B, min_flow: int = MIN_FLOW) -> DataFrame:
    """Blocks of one section's claims: ``min_flow`` of flow claims first, then by weight and claim; each span once."""
    b = blocks.withColumn("weight", claim_weight(F.col("text"), F.col("confidence"))).withColumn("flow", is_flow(F.col("text"))).filter((F.col("weight") > 0) | F.col("flow"))
    order = [F.desc("weight"), F.asc("claim_id"), F.asc("src_ord")]
    once = b.withColumn("_rn", F.row_number().over(Window.partitionBy("file_path", "start_line", "end_line").orderBy(F.desc("flow"), *order))).filter("_rn = 1")
    flow = F.row_number().over(Window.partitionBy("flow").orderBy(*order))
    first = once.withColumn("late", F.when(F.col("flow") & (flow <= min_flow), 0).otherwise(1))
    return first.orderBy("late", *order).limit(most).drop("_rn")


def layer_a(chunks: DataFrame, most: int = LAYER_A, by: Sequence[str] = ()) -> DataFrame:
    return first_rows(chunks.withColumn("rich", richness()), [F.desc("rich"), F.asc("id")], most, by)


def draft_context(chunks: DataFrame, blocks: DataFrame, most_a: int = LAYER_A, most_b: int = LAYER_B, min_flow: int = MIN_FLOW) -> DataFrame:
    """What a writer gets for a draft, in order of pos: the richest chunks, then source blocks of claims."""
    a = layer_a(chunks, most_a).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rich"), "id"))).drop("rich")
    b = layer_b(blocks, most_b, min_flow).withColumn("pos", F.row_number().over(Window.orderBy("late", F.desc("weight"), "claim_id", "src_ord"))).select("id", "file_path", "unit_type", "content", "pos")
    return merge_ranked([a, b], most_a + most_b)


def file_count(chunks: DataFrame) -> DataFrame:
    """One row, n: distinct files, chunks without one counted by id."""
    return chunks.agg(F.count_distinct(F.coalesce(F.when(~blank(F.col("file_path")), F.col("file_path")), F.when(~blank(F.col("id")), F.col("id")))).alias("n"))
