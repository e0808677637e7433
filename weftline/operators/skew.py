"""Joins by a key of which one value may hold a large part of either side's rows.

Rows of a hot key are dealt to several tasks, and the other side's rows of that key are copied to each of these. What is
broadcast is hot keys and their numbers of tasks only, fewer than MOST_HOT rows for each side, however the tables grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it has more rows than both LEAST_HOT and 1 / MOST_HOT of all, so there are fewer than MOST_HOT hot keys.
LEAST_HOT, MOST_HOT = 100_000, 2_000
#: Rows of a task where all rows are grouped.
TASK_ROWS = 250_000
#: Rows in a list of a key's rows. Eight or a multiple: Parquet packs numbers of values by eight, so a list that comes again is bytes that come again.
#: And LEAST_HOT of the side that is in lists.
LIST_ROWS, LEAST_LISTED = 256, 2_048


def spread(rows: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """n rows (or about as many) dealt by keys to tasks of TASK_ROWS, as a step before they are grouped by these keys.

    The number of tasks grows with the rows, so a task's memory does not. Grouping needs no table of a whole part of the input before
    the shuffle; it suits keys that are mostly unique.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), *keys)


def hot_keys(rows: DataFrame, key: str, least: int | None = None) -> DataFrame:
    """(key, _tasks): the hot keys of rows, and how many tasks share each one's rows. ``least`` stands for LEAST_HOT."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(LEAST_HOT if least is None else least), F.ceil(counts.agg(F.sum("n")).scalar() / MOST_HOT))
    return counts.filter(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_tasks"))


def _dealt(rows: DataFrame, hot: DataFrame | None, key: str, name: str, spread: Sequence[str]) -> DataFrame:
    """rows with ``name``: the task of each row of a hot key, by a hash of what ``spread`` names, so that a lost task's rows are dealt again alike."""
    if hot is None:
        return rows.withColumn(name, F.lit(0))
    marked = rows.join(F.broadcast(hot), key, "left")
    return marked.withColumn(name, F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_tasks")), F.lit(0)).cast("int")).drop("_tasks")


def _copied(rows: DataFrame, hot: DataFrame | None, key: str, name: str) -> DataFrame:
    """rows once for each task of the other side's rows of their key."""
    if hot is None:
        return rows.withColumn(name, F.lit(0))
    each: Column = F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), key, "left").withColumn(name, each).drop("_tasks")


def join(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], hot: DataFrame | None = None, right_hot: DataFrame | None = None, right_spread: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """left and right by ``key``; null keys meet nothing.

    hot: left's ``hot_keys``, whose rows are dealt by the columns of ``spread``; right_hot: right's, so that a key that is hot on both
    sides is a grid of tasks. An inner join takes both; of ``left_semi`` and ``left_anti``, whose right side has each key once, left's only.
    """
    if how != "inner" and right_hot is not None:
        raise ValueError(f"{how} deals rows of the left side only")
    a = _copied(_dealt(left, hot, key, "_l", spread), right_hot, key, "_r")
    b = _dealt(_copied(right, hot, key, "_l"), right_hot, key, "_r", right_spread)
    return a.join(b, [key, "_l", "_r"], how).drop("_l", "_r")


def join_many(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], hot: DataFrame, right_spread: Sequence[str]) -> DataFrame:
    """An inner ``join`` that makes far more rows than it reads.

    Its tasks are as many as a shuffle has parts, not as few as its small sides fill. A key's rows of right are lists of LIST_ROWS, and a
    list meets all rows of left before the next one does: rows come out in runs of a row of left, and what they hold of right comes again
    list by list, so files hold them in a fraction of the bytes that they take in another order.
    """
    spark, on = left.sparkSession, [key, "_l", "_r"]
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    right_hot = hot_keys(right, key, LEAST_LISTED)
    a = _copied(_dealt(left, hot, key, "_l", spread), right_hot, key, "_r").repartition(tasks, *on)
    b = _dealt(_copied(right, hot, key, "_l"), right_hot, key, "_r", right_spread).repartition(tasks, *on)
    own = [c for c in right.columns if c != key]
    number = F.row_number().over(Window.partitionBy(*on).orderBy(*own))
    lists = b.withColumn("_list", F.floor((number - 1) / LIST_ROWS)).groupBy(*on, "_list").agg(F.collect_list(F.struct(*own)).alias("_rows"))
    return lists.hint("merge").join(a, on).select(*left.columns, F.inline("_rows"))
