"""Contracts as rule columns: every broken rule is reported, not only the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``errors``, the names of broken rules in their order; a rule that is null is broken."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return df.withColumn("errors", F.array_compact(broken))


def error_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def used_before_created(df: DataFrame, scope: str, order: str, element: str, creates: Column) -> DataFrame:
    """Uses of an element that no earlier row of its scope created."""
    first = F.min(F.when(creates, F.col(order))).over(Window.partitionBy(scope, element))
    return df.withColumn("created_at", first).where(~creates & (F.col("created_at").isNull() | (F.col("created_at") > F.col(order))))


def two_sided(df: DataFrame, scope: str, kind: Column, first: str, second: str) -> DataFrame:
    """Scopes that have one of two kinds of rows but not the other."""
    seen = df.groupBy(scope).agg(F.count_if(kind == first).alias("n_first"), F.count_if(kind == second).alias("n_second"))
    return seen.where((F.col("n_first") > 0) != (F.col("n_second") > 0))
