"""Chunks of symbols, of segments and of files, their order, budget and storage rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.exprs import CODE_TYPES, chunk_priority, concise_signature, cut, trim_ws
from weftline.operators.graph import neighbors_in, neighbors_out

SYMBOL_CUT, FILE_CUT, CUT_SUFFIX = 1200, 3000, "\n... (truncated)"
SEGMENT_LINES, SEGMENT_OVERLAP, MAX_SEGMENTS, SEGMENT_OVER = 40, 8, 3, 45
SOURCE_CONFIDENCE = 0.9


def _source(relation: str, start: Column, end: Column, symbol: str = "id", path: str = "filepath") -> Column:
    return F.struct(F.col(symbol).alias("symbol_id"), F.col(path).alias("file_path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.lit(relation).alias("relation"), F.lit(SOURCE_CONFIDENCE).alias("confidence"))


def _names(pairs: DataFrame, symbols: DataFrame, column: str) -> DataFrame:
    named = pairs.join(symbols.select(F.col("id").alias("neighbor"), F.col("name").alias("neighbor_name")), "neighbor")
    return named.groupBy("id").agg(F.array_sort(F.collect_list("neighbor_name")).alias(column))


def symbol_chunks(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One chunk for each symbol. Neighbours' names keep duplicates, sorted; a hub's list grows with its degree."""
    s = symbols.join(_names(neighbors_out(edges, symbols), symbols, "dependencies"), "id", "left").join(_names(neighbors_in(edges, symbols), symbols, "used_by"), "id", "left")
    none = F.array().cast("array<string>")
    return s.select(
        "id", F.col("filepath").alias("file_path"), "name", "unit_type", "package", "description", concise_signature(F.col("signature"), F.col("content"), F.col("name")).alias("signature"),
        "content", "content_hash", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("used_by", none).alias("used_by"), F.array(_source("primary", F.col("start_line"), F.col("end_line"))).alias("sources"),
    )


def segments(chunks: DataFrame, lines: int = SEGMENT_LINES, overlap: int = SEGMENT_OVERLAP, most: int = MAX_SEGMENTS, over: int = SEGMENT_OVER, max_chars: int = SYMBOL_CUT) -> DataFrame:
    """Overlapping windows of lines of functions and methods of more than ``over`` lines, after the cut. A blank window is left out but keeps its number."""
    body = cut(F.col("content"), max_chars, CUT_SUFFIX) if max_chars else F.col("content")
    long = chunks.filter(F.col("unit_type").isin("function", "method")).withColumn("_lines", F.split(body, "\n")).filter((F.size("_lines") > over) & (trim_ws(F.col("content")) != ""))
    step = max(1, lines - overlap) if lines > overlap else lines
    starts = F.slice(F.sequence(F.lit(0), F.size("_lines") - 1, F.lit(step)), 1, most)
    at = long.select("*", F.posexplode(starts).alias("_i", "_from"))
    block = trim_ws(F.array_join(F.slice("_lines", F.col("_from") + 1, F.lit(lines)), "\n"))
    number = (F.col("_i") + 1).cast("string")
    end = F.least(F.col("_from") + lines, F.size("_lines"))
    shifted = F.transform("sources", lambda s: F.struct(s["symbol_id"].alias("symbol_id"), s["file_path"].alias("file_path"), (s["start_line"] + F.col("_from")).alias("start_line"), (s["start_line"] + end - 1).alias("end_line"), F.lit("context").alias("relation"), s["confidence"].alias("confidence")))
    told = F.concat(trim_ws(F.coalesce("description", F.lit(""))), F.lit(" [segment "), number, F.lit("]"))
    out = at.withColumns({"content": block, "id": F.concat("id", F.lit("::seg:"), number), "content_hash": F.concat("content_hash", F.lit("::seg:"), number), "description": told, "sources": shifted, "unit_type": F.lit("symbol_segment")})
    return out.filter(F.col("content") != "").select(chunks.columns)


def file_chunks(symbols: DataFrame, chunks: DataFrame, max_chars: int = FILE_CUT) -> DataFrame:
    """One chunk for each file, its symbols in order of (start_line, id). chunks are the symbols' chunks.

    Code after the cut is dropped before symbols are collected, by the length of what stands before it in its file.
    What is collected of a file's symbols bounds a row: names, descriptions, signatures and hashes.
    """
    s = symbols.select("id", "filepath", "start_line", "end_line", "content").join(chunks.drop("content", "sources", "file_path"), "id")
    is_code, shape = F.col("unit_type").isin(*CODE_TYPES), F.col("unit_type").isin("struct", "interface")
    code = F.when(is_code, F.concat(F.lit("// "), F.col("unit_type"), F.lit(" "), F.col("name"), F.lit("\n"), F.col("content"), F.lit("\n\n"))).otherwise("")
    before = Window.partitionBy("filepath").orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("code", F.substring(code, 1, max_chars + 1)).withColumn("code", F.when(F.coalesce(F.sum(F.length("code")).over(before), F.lit(0)) <= max_chars, F.col("code")).otherwise(""))
    row = F.struct(
        "start_line", "id", F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.col("unit_type"), F.lit("): "), F.coalesce("description", F.lit("")), F.lit("\n")).alias("told"), "code",
        F.when(shape, F.concat(F.col("signature"), F.lit("\n\n"))).otherwise("").alias("shape"), F.coalesce("content_hash", F.lit("")).alias("hash"),
        "dependencies", "used_by", _source("primary", F.col("start_line"), F.col("end_line")).alias("source"), "package",
    )
    g = s.groupBy("filepath").agg(F.sort_array(F.collect_list(row)).alias("r"))
    joined = lambda field: F.array_join(F.transform("r", lambda x: x[field]), "")
    names = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda x: x[field]))))
    name = F.substring_index("filepath", "/", -1)
    head = F.concat(F.lit("Module `"), name, F.lit("` in package `"), F.col("r")[0]["package"], F.lit("` containing:\n"))
    return g.select(
        F.col("filepath").alias("id"), F.col("filepath").alias("file_path"), name.alias("name"), F.lit("file_module").alias("unit_type"), F.col("r")[0]["package"].alias("package"),
        F.concat(head, joined("told")).alias("description"), joined("shape").alias("signature"), cut(joined("code"), max_chars, CUT_SUFFIX).alias("content"), joined("hash").alias("content_hash"),
        names("dependencies").alias("dependencies"), names("used_by").alias("used_by"), F.transform("r", lambda x: x["source"]).alias("sources"),
    )


def prepare(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """All chunks: symbols (content cut), segments, files."""
    chunks = symbol_chunks(symbols, edges)
    short = chunks.withColumn("content", cut(F.col("content"), SYMBOL_CUT, CUT_SUFFIX))
    return short.unionByName(segments(chunks)).unionByName(file_chunks(symbols, chunks))


def by_priority() -> list[Column]:
    return [F.desc("priority"), F.asc("id"), F.asc("content_hash")]


def prioritized(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("priority", chunk_priority())


def budget(chunks: DataFrame, most: int) -> DataFrame:
    """At most ``most`` chunks with their phase: 0 within quota, 1 further symbols, 2 further files.

    Files have a quarter of a budget of 8 or more, one place of 4 or more, else none; symbols have the rest.
    The first ``most`` of symbols and of files are taken by a bounded heap in each task, and only these are ranked.
    """
    ranked = prioritized(chunks).withColumn("is_file", F.col("unit_type") == "file_module")
    if most <= 0:
        return ranked.withColumn("phase", F.lit(0))
    files = most // 4 if most >= 8 else 1 if most >= 4 else 0
    rank = F.row_number().over(Window.partitionBy("is_file").orderBy(*by_priority()))
    heads = [ranked.filter(side).orderBy(*by_priority()).limit(most) for side in (F.col("is_file"), ~F.col("is_file"))]
    first = heads[0].unionByName(heads[1]).withColumn("rn", rank)
    quota = F.when(F.col("is_file"), files).otherwise(most - files)
    phased = first.withColumn("phase", F.when(F.col("rn") <= quota, 0).when(~F.col("is_file"), 1).otherwise(2))
    return phased.orderBy("phase", "is_file", "rn").limit(most)


def unchanged(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that need embedding: not those stored with the same hash, nor those without id."""
    has = stored.filter(F.coalesce("content_hash", F.lit("")) != "").select("id", "content_hash")
    return chunks.filter(F.coalesce(F.trim("id"), F.lit("")) != "").join(has, ["id", "content_hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """old with the rows of new put in place by key; of new rows with a key the last in ``order`` counts."""
    if order:
        new = new.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_rn = 1").drop("_rn")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """chunks without those whose id or file is in targets (target): two joins, since one with OR would be a nested loop."""
    return chunks.join(targets.select(F.col("target").alias("id")), "id", "left_anti").join(targets.select(F.col("target").alias("file_path")), "file_path", "left_anti").select(chunks.columns)


def last_by_id(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("id").agg(F.max_by(F.struct(*nodes.columns), F.struct("filepath", "start_line")).alias("n")).select("n.*")


def snapshot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a snapshot stores: a node for each id (the last by file and line), an edge for each (from, to, kind)."""
    return last_by_id(nodes), edges.dropDuplicates(["from_id", "to_id", "kind"])


def collisions(nodes: DataFrame) -> DataFrame:
    """(id, n) of ids that several symbols share."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
