"""Elements that move, grow and turn, and loops whose rounds end early, as windows over ordered commands.

A command that sets a value starts an era; within an era, changes add up or
multiply.  An element's commands are thus never folded in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A loop runs at most so many rounds.
MOST_ROUNDS = 100_000


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def moved(df: DataFrame, keys: list[str], order: list[str], value: Column, relative: Column, start: Column | None = None, keep: int | None = -1, to: str = "at") -> DataFrame:
    """One coordinate after each move command.

    A value that is ``keep`` (None: no such value) or null changes nothing;
    a relative one is added, others are the new place.  Elements start at
    ``start``, else at zero.
    """
    given = value if keep is None else F.when(value != keep, value)
    rows = df.withColumn("value_", given).withColumn("set_", F.coalesce(~relative, F.lit(True)) & F.col("value_").isNotNull())
    rows = rows.withColumn("era_", F.count_if("set_").over(_ordered(keys, order)))
    total = F.sum(F.coalesce("value_", F.lit(0))).over(_ordered([*keys, "era_"], order))
    first = F.when(F.col("era_") == 0, start) if start is not None else F.lit(None)
    return rows.withColumn(to, total + F.coalesce(first, F.lit(0))).drop("value_", "set_", "era_")


def scaled(df: DataFrame, keys: list[str], order: list[str], value: Column, relative: Column, to: str = "scale") -> DataFrame:
    """A scale after each command: relative ones multiply, a null or 0 among them counts as 1; others are set.

    Elements start at 1.  A scale that was set to 0 counts as 1 for what follows.
    A product that underflows stays 0 until the next set value.
    """
    given = value.cast("double")
    rows = df.withColumn("value_", given).withColumn("set_", F.coalesce(~relative, F.lit(True)) & F.col("value_").isNotNull())
    rows = rows.withColumn("era_", F.count_if("set_").over(_ordered(keys, order)))
    counts = F.col("set_") | F.coalesce(relative, F.lit(False))
    factor = F.when(counts & (F.col("value_") != 0), F.col("value_")).otherwise(1.0)
    product = F.product(factor).over(_ordered([*keys, "era_"], order))
    return rows.withColumn(to, F.when(F.col("set_"), F.col("value_")).otherwise(product)).drop("value_", "set_", "era_")


def turned(df: DataFrame, keys: list[str], order: list[str], degrees: Column, relative: Column, shortest: Column, to: str = "angle") -> DataFrame:
    """An angle in degrees after each command: relative ones are added, others are set.

    ``shortest`` ones turn to the same heading by at most half a turn, a half
    turn forwards.  A heading (an angle up to whole turns) does not depend on
    the way it was reached, so the turns to it are known before they are added.
    Null degrees change nothing.
    """
    near, add = F.coalesce(shortest, F.lit(False)), F.coalesce(relative, F.lit(False))
    rows = df.withColumn("degrees_", degrees)
    rows = moved(rows, keys, order, F.col("degrees_"), add, keep=None, to="heading_")
    before = F.coalesce(F.lag("heading_").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0))
    round_trip = F.pmod(F.col("heading_") - before, F.lit(360))
    way = F.when(round_trip > 180, round_trip - 360).otherwise(round_trip)
    rows = rows.withColumn("step_", F.when(F.col("degrees_").isNotNull(), F.when(near, way).otherwise(F.col("degrees_"))))
    return moved(rows, keys, order, F.col("step_"), near | add, keep=None, to=to).drop("degrees_", "heading_", "step_")


def counted_rounds(df: DataFrame, start: Column, end: Column, step: Column) -> DataFrame:
    """A row for each round of ``for i = start to end`` (``end`` excluded), with ``round`` and ``i``; at most ``MOST_ROUNDS``.

    A negative step counts down.  A step of zero never ends where the start is above the end, and has no round elsewhere.
    """
    rounds = F.when(step == 0, F.when(start > end, MOST_ROUNDS).otherwise(0)).otherwise(F.greatest(F.lit(0), F.ceil((end - start) / step)))
    rounds = F.least(rounds, F.lit(MOST_ROUNDS)).cast("int")
    many = F.when(rounds > 0, F.sequence(F.lit(0), rounds - 1))
    return df.withColumn("start_", start).withColumn("step_", step).withColumn("round", F.explode(many)).withColumn("i", F.col("start_") + F.col("round") * F.col("step_")).drop("start_", "step_")


def item_rounds(df: DataFrame, items: Column) -> DataFrame:
    """A row for each entry of ``items``, with ``round`` and ``item``; at most ``MOST_ROUNDS``."""
    return df.select("*", F.posexplode(F.slice(items, 1, MOST_ROUNDS)).alias("round", "item"))


def executed(df: DataFrame, keys: list[str], round: str, place: str, success: Column, go_on: Column, breaks: Column, command: str | None = None, next_command: str | None = None) -> DataFrame:
    """Commands of loop bodies that run, in rounds: with ``extra``, true for those that a command calls for once more.

    In a round, commands run in order of ``place`` to the first failure, unless
    that command has ``go_on``.  A break that ran ends the loop, but only after
    its round.  After a command that names another of its round by
    ``next_command``, the first one of that id (``command``) runs once more; its
    failure stops nothing, its break counts.
    """
    told = df.withColumns({"ok_": F.coalesce(success, F.lit(False)), "breaks_": F.coalesce(breaks, F.lit(False)), "stops_": ~F.coalesce(success, F.lit(False)) & ~F.coalesce(go_on, F.lit(False))})
    inside = Window.partitionBy(*keys, round).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    ran = told.withColumn("stopped_", F.coalesce(F.max("stops_").over(inside), F.lit(False))).where("not stopped_").drop("stopped_", "stops_").withColumn("extra", F.lit(False))
    if command and next_command:
        first = told.groupBy(*keys, round, command).agg(F.min_by(F.struct(*(c for c in told.columns if c not in [*keys, round, command, "stops_"])), place).alias("row_"))
        calls = ran.where(F.col(next_command).isNotNull()).select(*keys, round, F.col(next_command).alias(command), F.col(place).alias("after_"))
        more = calls.join(first, [*keys, round, command]).select(*keys, round, command, "row_.*", "after_").withColumn("extra", F.lit(True))
        ran = ran.withColumn("after_", F.col(place)).unionByName(more).drop(place).withColumnRenamed("after_", place)
    # the first round with a break that ran; later ones do not begin
    last = ran.where("breaks_ and ok_").groupBy(*keys).agg(F.min(round).alias("last_"))
    return ran.join(last, keys, "left").where(F.col("last_").isNull() | (F.col(round) <= F.col("last_"))).drop("last_", "breaks_", "ok_")
