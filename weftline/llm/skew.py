"""Joins by a key of which one value may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more rows than both LEAST_HOT and 1 / MOST_HOT of all, so there are fewer than MOST_HOT hot keys.
LEAST_HOT, MOST_HOT = 1000, 10_000


def attach(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table`` of the same ``key`` (inner join; null keys meet nothing).

    counts: key and n, the rows of each key. The part of table that hot keys need is broadcast: MOST_HOT keys bound it.
    Their rows stay where they are, and the others meet in a shuffle, where no key has more rows than the threshold.
    """
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    threshold = max(LEAST_HOT, (total or 0) // MOST_HOT)
    if (top or 0) <= threshold:
        return rows.join(table, key)
    hot = F.broadcast(counts.filter(F.col("n") > threshold).select(key))
    kept = rows.join(F.broadcast(table.join(hot, key, "left_semi")), key)
    return kept.unionByName(rows.join(hot, key, "left_anti").join(table, key))
