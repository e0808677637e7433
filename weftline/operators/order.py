"""Positions and running sums in an order of all rows, without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.staging import stage


def first_rows(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """The first k rows of each group, or of all rows without groups; either way each task cuts its own rows before they are shuffled."""
    if not by:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_first", rank).filter(F.col("_first") <= k).drop("_first")


def sorted_tasks(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """``df`` staged in range-sorted tasks, with ``at`` (place, which grows along the order) and ``task``."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = stage(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), tag)
    return placed.withColumn("task", F.shiftright("at", 33))


def summed(df: DataFrame, order: list[Column], tag: str, **sums: Column) -> DataFrame:
    """``df`` with ``row``, from 0 in the order of all rows, and for each of sums the sum of all rows before: in its task, and the totals of earlier tasks, one row for each."""
    placed = sorted_tasks(df, order, tag)
    values = {"row": F.lit(1), **sums}
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("task").agg(*(F.sum(v).alias(n) for n, v in values.items()))
    totals = totals.select(F.col("task").alias("t"), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in values))
    inside = Window.partitionBy("task").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}).join(totals, F.col("task") == F.col("t"))
    return out.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in values}).drop("at", "task", "t", *(f"{n}_before" for n in values))
