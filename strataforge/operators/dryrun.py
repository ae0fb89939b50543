"""Assertions on runs: what variables, elements and logs show after scripted actions.

Facts are aggregated once for each run and name; an assertion then needs one
equi-join with each table of facts, however long a run's log is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON texts that count as false.
FALSE = ("null", "false", "0", "-0", "0.0", "-0.0", '""')
#: Assertions that hold from a number on, or with ``exact`` at that number only.
COUNTED = ("event_emitted", "command_executed", "event_executed", "event_execution_count", "event_execution_after_actions")


def truthy_json(json: Column) -> Column:
    """Whether a JSON text counts as true; an absent value does not."""
    return F.coalesce(~json.isin(*FALSE), F.lit(False))


def checked(wanted: DataFrame, variables: DataFrame, elements: DataFrame, log: DataFrame) -> DataFrame:
    """``(run, assertion, type, actual, expected, passed)`` for every row of ``wanted``.

    ``wanted``: ``run, assertion, type, name, value, count, exact, x, y,
    tolerance, property``; an absent count or tolerance is 1.  ``variables``:
    ``run, name, before, after``, one row a variable, with its value before and
    after the actions.  ``elements``: ``run, element, x, y, properties`` (a map),
    one row an element.  ``log``: ``run, kind, id, success, late``; a kind is
    ``event``, ``command`` or ``execution`` (of an event's commands), ``late``
    rows came after the actions began.  Values are JSON texts and are compared
    as they stand; null is an absent value, which equals only an absent one.
    Types that are not known fail.
    """
    rows = wanted.withColumn("type", F.lower(F.coalesce("type", F.lit("")))).withColumn("count", F.coalesce(F.col("count").cast("long"), F.lit(1)))
    kind = F.when(F.col("type") == "event_emitted", "event").when(F.col("type") == "command_executed", "command").when(F.col("type") == "event_executed", "execution")
    rows = rows.withColumn("kind", kind)
    named = variables.select("run", "name", "after")
    shared = variables.groupBy("run", F.col("after").alias("value")).agg(F.count("*").alias("n_held"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_new"))
    lit = variables.groupBy("run").agg(F.count_if(truthy_json(F.col("after"))).alias("n_true"))
    shown = elements.select("run", F.col("element").alias("name"), F.col("x").alias("at_x"), F.col("y").alias("at_y"), "properties", F.lit(True).alias("there"))
    seen = log.groupBy("run", "kind", F.col("id").alias("name")).agg(F.count("*").alias("n_seen"), F.count_if("success").alias("n_success"))
    ran = log.where("kind = 'execution'").groupBy("run").agg(F.count("*").alias("n_ran"), F.count_if("late").alias("n_late"))
    rows = rows.join(named, ["run", "name"], "left").join(shared, ["run", "value"], "left").join(lit, "run", "left")
    rows = rows.join(shown, ["run", "name"], "left").join(seen, ["run", "kind", "name"], "left").join(ran, "run", "left")

    of = F.col("type")
    number = F.when(of == "any_variable_equals", F.col("n_held")).when(of == "variable_changed_after_actions", F.col("n_new")).when(of == "truthy_variable_count", F.col("n_true"))
    number = number.when(of == "command_executed", F.col("n_success")).when(of.isin("event_emitted", "event_executed"), F.col("n_seen"))
    number = F.coalesce(number.when(of == "event_execution_count", F.col("n_ran")).when(of == "event_execution_after_actions", F.col("n_late")), F.lit(0))
    there, near = F.coalesce("there", F.lit(False)), F.coalesce(F.col("tolerance").cast("double"), F.lit(1.0))
    held = F.try_element_at(F.col("properties"), F.col("property"))
    by_value = ("variable_equals", "any_variable_equals", "variable_changed_after_actions", "element_property_equals")
    point = lambda x, y: F.concat_ws(",", x, y)

    actual = F.when(of.isin("variable_equals", "variable_truthy"), F.col("after")).when(of == "element_exists", there.cast("string")).when(of == "element_property_equals", held)
    actual = actual.when(of == "element_position", F.when(there, point("at_x", "at_y"))).when(of.isin("any_variable_equals", "variable_changed_after_actions", "truthy_variable_count", *COUNTED), number.cast("string"))
    expected = F.when(of.isin(*by_value), F.col("value")).when(of.isin("variable_truthy", "element_exists"), "true").when(of == "element_position", point("x", "y"))
    expected = expected.when(of.isin("truthy_variable_count", *COUNTED), F.col("count").cast("string"))
    passed = F.when(of == "variable_equals", F.col("after").eqNullSafe(F.col("value"))).when(of == "variable_truthy", truthy_json(F.col("after")))
    passed = passed.when(of.isin("any_variable_equals", "variable_changed_after_actions"), number > 0).when(of == "truthy_variable_count", number >= F.col("count"))
    passed = passed.when(of == "element_exists", there).when(of == "element_property_equals", held.eqNullSafe(F.col("value")))
    passed = passed.when(of == "element_position", there & (F.abs(F.col("at_x") - F.col("x")) <= near) & (F.abs(F.col("at_y") - F.col("y")) <= near))
    passed = passed.when(of.isin(*COUNTED), F.when(F.coalesce("exact", F.lit(False)), number == F.col("count")).otherwise(number >= F.col("count")))
    known = expected.isNotNull() | of.isin(*by_value)
    return rows.select("run", "assertion", "type", F.when(known, actual).otherwise("unsupported assertion").alias("actual"), F.when(known, expected).otherwise(of).alias("expected"), F.coalesce(passed, F.lit(False)).alias("passed"))


def run_verdicts(results: DataFrame) -> DataFrame:
    """``(run, passed, failed)``: whether all assertions of a run hold, and the failed ones in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("assertion"))))
    return results.groupBy("run").agg(F.every("passed").alias("passed"), failed.alias("failed"))
