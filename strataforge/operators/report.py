"""Counts, shares, summaries and scores of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, kind: str, group: str) -> DataFrame:
    """Per kind: count, share of all rows, groups that use it and their share of all groups, rank by count then name.

    Only one row per kind reaches the single-partition steps.
    """
    pairs = df.groupBy(kind, group).agg(F.count("*").alias("n"))
    per_kind = pairs.groupBy(kind).agg(F.sum("n").alias("n"), F.count("*").alias("groups_using"))
    groups = df.select(group).distinct().agg(F.count("*").alias("all_groups"))
    every = Window.partitionBy(F.lit(0))
    out = per_kind.crossJoin(F.broadcast(groups)).withColumn("rank", F.row_number().over(every.orderBy(F.desc("n"), kind)))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(every), 3)
    return out.select("rank", kind, "n", share.alias("share_percent"), "groups_using", F.round(100.0 * F.col("groups_using") / F.col("all_groups"), 3).alias("coverage_percent"))


def two_key_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(first, second).agg(F.count("*").alias("n"))


def state_counts(df: DataFrame, column: str, states: list[str]) -> DataFrame:
    """A row per listed state, zero where it does not occur."""
    found = df.groupBy(F.col(column).alias("state")).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(s,) for s in states], "state string")
    return wanted.join(found, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_messages(df: DataFrame, message: str, most: int = 20) -> DataFrame:
    return df.groupBy(F.col(message).alias("message")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "message").limit(most)


def percentiles(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Smallest, nearest-rank p50, p95 and p99, and largest value; nearest rank is Spark's ``percentile_disc``."""
    disc = lambda q: F.expr(f"cast(percentile_disc({q}) within group (order by {value}) as long)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), disc(0.99).alias("p99"), F.max(value).alias("high"))


def summary_with_total(df: DataFrame, category: str, **measures: Column) -> DataFrame:
    """Measures per category and over all rows (category null, ``is_total`` 1) in one pass."""
    out = df.rollup(category).agg(F.grouping(category).cast("int").alias("is_total"), *(c.alias(n) for n, c in measures.items()))
    return out


def votes(df: DataFrame, case: str, verdict: str, score: str, spread: float = 1.0) -> DataFrame:
    """Several judgements of a case: unanimous and close ones stand, all others go to review."""
    counted = df.groupBy(case).agg(F.count("*").alias("n"), F.min(verdict).alias("low"), F.max(verdict).alias("high"), F.round(F.avg(score), 4).alias("mean"), F.round(F.stddev_pop(score), 4).alias("deviation"))
    agreed = (F.col("low") == F.col("high")) & (F.col("deviation") <= spread)
    return counted.select(case, "n", "mean", "deviation", F.when(agreed, F.col("low")).otherwise("review").alias("decision"))


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted mean of dimensions; the weights must add up to one."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must add up to one")
    return sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
