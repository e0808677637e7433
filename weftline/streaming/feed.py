"""An extension without a counterpart in batch: diffs that arrive as files drive the plan of sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftline.plans.sync import reach_sections
from weftline.sources.diff import parse, path_of

SCHEMA = "diff string, arrived timestamp, line_no long, line string"


def read(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """Lines of diffs from Parquet files of SCHEMA; a line that comes again within ``late`` is dropped."""
    lines = spark.readStream.schema(SCHEMA).parquet(folder)
    return lines.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["diff", "line_no"])


def touched_by_window(lines: DataFrame, window: str = "5 minutes") -> DataFrame:
    """(window, path, hunks) counted in windows of arrival."""
    return lines.withColumn("path", path_of("line")).filter("path <> ''").groupBy(F.window("arrived", window), "path").agg(F.count(F.lit(1)).alias("changes"))


def plan_on_arrival(lines: DataFrame, symbols: DataFrame, edges: DataFrame, sources: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """For each batch of diffs, the sections that it affects go to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        changes = parse(batch).groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("changed_lines")))).alias("changed_lines"))
        sections, _ = reach_sections(symbols, edges, changes, sources)
        sink(sections, number)

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
