"""Order statistics by several definitions, exact, without a group in one task.

Equal values are counted before anything is sorted.  The range of each group is
cut into stretches at approximate quantiles, which need not be exact: the counts
of the stretches tell in which of them a wanted rank lies, and only these are
sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stretches of a group at most.
STRETCHES = 64


def nearest(n: Column, q: float) -> Column:
    """The smallest rank (from 0) with a share of at least ``q`` of the values at or below it."""
    return F.ceil(n * F.lit(float(q))) - 1


def half_even(n: Column, q: float) -> Column:
    """The rank nearest to ``(n - 1) q``; of two equally near ones the even one."""
    return F.rint((n - 1) * F.lit(float(q)))


def cut(n: Column, q: float) -> Column:
    """``n q`` without its fraction."""
    return F.floor(n * F.lit(float(q)))


def lower_middle(n: Column, _: float = 0.5) -> Column:
    return F.floor((n - 1) / 2)


def upper_middle(n: Column, _: float = 0.5) -> Column:
    return F.floor(n / 2)


def order_statistics(df: DataFrame, group: list[str], value: str, wanted: dict[str, tuple], stretches: int = STRETCHES) -> DataFrame:
    """``group`` columns, ``n``, and a column for each of ``wanted``: name to ``(definition, q)``.

    Null values do not count; a group without values has no row.  Ranks beyond
    either end are the ends.  ``median`` as a definition is the mean of the two
    middle values.
    """
    ranks: dict[str, tuple] = {}
    for name, (definition, q) in wanted.items():
        if definition == "median":
            ranks |= {f"{name}_low_": (lower_middle, q), f"{name}_high_": (upper_middle, q)}
        else:
            ranks[name] = (definition, q)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v_")).agg(F.count("*").alias("c_"))
    steps = [F.lit(i / stretches) for i in range(1, stretches)]
    cuts = counts.groupBy(*group).agg(F.sum("c_").alias("n"), F.array_distinct(F.percentile_approx("v_", F.array(*steps), F.lit(stretches * 40))).alias("cuts_"))
    theirs = cuts.select(*(F.col(g).alias(f"g_{g}") for g in group), "n", "cuts_")
    joined = counts.join(theirs, [F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in group] or F.lit(True)).select(*group, "v_", "c_", "n", "cuts_")
    placed = joined.withColumn("s_", F.size(F.filter("cuts_", lambda x: x < F.col("v_")))).drop("cuts_")
    sums = placed.groupBy(*group, "s_").agg(F.sum("c_").alias("in_"), F.first("n").alias("n"))
    # at most ``stretches`` rows a group
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy("s_")
    upto = sums.withColumn("before_", F.sum("in_").over(over) - F.col("in_"))
    entry = lambda name, of, q: F.struct(F.lit(name).alias("name"), F.greatest(F.least(of(F.col("n"), q).cast("long"), F.col("n") - 1), F.lit(0)).alias("rank"))
    asked = upto.withColumn("w_", F.explode(F.array(*(entry(name, of, q) for name, (of, q) in ranks.items())))).select(*group, "s_", "n", "before_", "in_", "w_.name", "w_.rank")
    asked = asked.where((F.col("before_") <= F.col("rank")) & (F.col("rank") < F.col("before_") + F.col("in_")))
    hit = asked.select(*(F.col(g).alias(f"g_{g}") for g in group), F.col("s_").alias("t_"), "name", (F.col("rank") - F.col("before_")).alias("at_"))
    needed = hit.select(*(f"g_{g}" for g in group), "t_").distinct()
    same = [F.col(g).eqNullSafe(F.col(f"g_{g}")) for g in group] + [F.col("s_") == F.col("t_")]
    inside = placed.join(needed, same, "left_semi").select(*group, "s_", "v_", "c_", "n")
    order = Window.partitionBy(*group, "s_").orderBy("v_")
    inside = inside.withColumn("to_", F.sum("c_").over(order))
    found = inside.join(hit, [*same, F.col("to_") - F.col("c_") <= F.col("at_"), F.col("at_") < F.col("to_")]).groupBy(*group).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("v_"))).alias(name) for name in ranks))
    columns = [((F.col(f"{name}_low_") + F.col(f"{name}_high_")) / 2).alias(name) if definition == "median" else F.col(name) for name, (definition, _) in wanted.items()]
    return found.select(*group, "n", *columns)


def lowest(df: DataFrame, group: list[str], score: str, key: str, flagged: Column, most: int = 100) -> DataFrame:
    """``group`` and ``ids``: keys of at most ``most`` flagged rows, lowest scores first, joined by commas."""
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(score, key)
    rows = df.where(flagged).withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= most)
    return rows.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_", key))), lambda x: x[key].cast("string")), ",").alias("ids"))
