"""Operators that depend on the order of rows: frames, latest rows, changes, merges, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_frame(df: DataFrame, keys: list[str], order: str, value: Column, before: int, after: int) -> DataFrame:
    """Neighbours of each row in its stream by ordinal distance, so that gaps in the ordinals count."""
    frame = Window.partitionBy(*keys).orderBy(order).rangeBetween(-before, after)
    return df.withColumn("context", F.collect_list(value).over(frame))


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a maximum of structs, so that no key's rows meet in one task unaggregated."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("row_")
    return df.groupBy(*keys).agg(row).select(*keys, "row_.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``changes`` replace those of ``base`` with the same key; within a table the last row counts."""
    both = base.withColumn("from_", F.lit(0)).unionByName(changes.withColumn("from_", F.lit(1)))
    return latest(both, [key], ["from_", order]).drop("from_")


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their stream, with the old value."""
    old = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("old", old).where(~F.col("old").eqNullSafe(F.col(value)))


def overwritten(df: DataFrame, scope: list[str], order: str, target: str) -> DataFrame:
    """Rows whose target the next row of their scope sets again."""
    following = F.lead(target).over(Window.partitionBy(*scope).orderBy(order))
    return df.withColumn("next_", following).where(F.col("next_") == F.col(target)).drop("next_")


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of an ordered table; page numbers start at 1 and are cut to it."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def until_failure(df: DataFrame, stream: str, order: str, failed: Column) -> DataFrame:
    """Rows up to and with the first failure of each stream."""
    earlier = F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("failed_", F.coalesce(earlier, F.lit(0))).where("failed_ = 0").drop("failed_")


def schedule(df: DataFrame, stream: str, order: list[str], duration: str) -> DataFrame:
    """Start of each step: the sum of the durations before it."""
    total = F.sum(duration).over(Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("starts_at", F.coalesce(total, F.lit(0)))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each left row with the latest right value at or before its time: one shuffle of both, no pairs."""
    rows = left.withColumn("side_", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(key, time, value).withColumn("side_", F.lit(0)), allowMissingColumns=True)
    frame = Window.partitionBy(key).orderBy(time, "side_").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(frame)).where("side_ = 1").drop("side_")
