"""Token counts for every context limit from one exact histogram of encoded lengths.

Documents aggregate to (length, documents); what a context limit keeps, cuts or totals
are sums over the shorter and the longer lengths. Lengths go by blocks: sums within a
block, plus the sums of later blocks, so no task sorts all lengths. The lengths and the
blocks are as many as distinct lengths at most.

A null text is empty, of length 0. Empty tables give no rows. Repeated rows count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128


def histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs of each length; null lengths count as 0."""
    return lengths.groupBy(F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length as a context limit, from (n_tokens, n_docs):

    docs_longer, tokens_longer: documents over the limit, and their tokens;
    tokens_kept: all tokens if each document is cut at the limit; tokens_lost: the rest;
    docs_upto: documents of this length or less; quantile: these as part of all.
    """
    h = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / block))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("in_d", F.coalesce(F.sum("n_docs").over(within), F.lit(0))).withColumn("in_t", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(blocks, "block")
    longer, beyond = F.col("in_d") + F.col("later_d"), F.col("in_t") + F.col("later_t")
    kept = F.col("all_t") - beyond + longer * F.col("n_tokens")
    return h.select(
        "n_tokens", "n_docs", "tokens", longer.alias("docs_longer"), beyond.alias("tokens_longer"), kept.alias("tokens_kept"), (F.col("all_t") - kept).alias("tokens_lost"),
        (F.col("all_d") - longer).alias("docs_upto"), ((F.col("all_d") - longer) / F.col("all_d")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """limits (context) with tokens_kept and docs_longer for any limits, also between lengths.

    At a limit the lengths over it lose n_tokens - limit each; the row of the largest length
    not over the limit has all that is needed. Limits are few: they are broadcast by plan only if small.
    """
    spans = sums.select("n_tokens", "docs_longer", "tokens_kept").withColumn("up_to", F.coalesce(F.lead("n_tokens").over(Window.orderBy("n_tokens")), F.lit(2**62)))
    found = limits.join(spans, (F.col("context") >= F.col("n_tokens")) & (F.col("context") < F.col("up_to")), "left")
    least = sums.agg(F.sum("n_docs").alias("docs"))
    return found.crossJoin(least).select("context", F.coalesce("docs_longer", "docs").alias("docs_longer"), F.coalesce(F.col("tokens_kept") + (F.col("context") - F.col("n_tokens")) * F.col("docs_longer"), F.col("docs") * F.col("context")).alias("tokens_kept"))
