"""Change feed: unified diff text without context lines to changed files and lines."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def path_of(line: str) -> Column:
    """The path of a file's header: what both sides name, or else the new side."""
    same = F.regexp_extract(line, r"^diff --git a/(.*) b/\1$", 1)
    return F.when(same != "", same).otherwise(F.regexp_extract(line, r"^diff --git .* b/(.*)$", 1))


def parse(lines: DataFrame, by: tuple[str, ...] = ("diff",)) -> DataFrame:
    """by, path, changed_lines from lines (by, line_no, line) of diffs.

    A header of a hunk gives the lines on the new side, one without a count; a count of 0 (a pure deletion) gives
    none. A file without hunks has an empty list. Paths may hold spaces. Lines of one diff are ordered in a group.
    """
    far = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_file = F.col("line").startswith("diff --git ")
    kept = lines.filter(is_file | F.col("line").startswith("@@ "))
    at = kept.withColumn("file_no", F.sum(is_file.cast("int")).over(far)).filter("file_no > 0")
    path = path_of("line")
    hunk = F.regexp_extract("line", r"^@@ -[0-9,]+ \+([0-9]+)", 1)
    count = F.regexp_extract("line", r"^@@ -[0-9,]+ \+[0-9]+,([0-9]+)", 1)
    start, n = F.col("hunk").try_cast("int"), F.coalesce(F.col("count").try_cast("int"), F.lit(1))
    at = at.withColumns({"path": F.when(is_file, path), "hunk": hunk, "count": count})
    span = F.when(start.isNotNull() & (n > 0), F.sequence(start, start + n - 1))
    g = at.groupBy(*by, "file_no").agg(F.max("path").alias("path"), F.array_sort(F.flatten(F.collect_list(span))).alias("changed_lines"))
    return g.select(*by, "path", "changed_lines")


def read(spark: SparkSession, path: str) -> DataFrame:
    """diff (the file's name), path, changed_lines of diff files."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return parse(text)


def changed_since(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """path, changed_lines of a working tree against ``ref``; runs git on the driver."""
    out = subprocess.run(["git", "-C", repo, "diff", "-U0", ref], capture_output=True, text=True, check=True).stdout
    rows = [("HEAD", i, line) for i, line in enumerate(out.splitlines())]
    return parse(spark.createDataFrame(rows, "diff string, line_no long, line string")).select("path", "changed_lines")
