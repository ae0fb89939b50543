"""Views of a data set whose requests are put into plain words while their outputs stay as they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from strataforge.functions.canonical import canonical_text

CATALOG = "array<struct<id:string,type:string,path:string,origin:string,exists:boolean>>"


def family_of(index: Column, bounds: list[tuple[int, str]]) -> Column:
    """The name of the first bound that ``index`` does not exceed; null beyond the last."""
    out = F.lit(None).cast("string")
    for upper, name in reversed(bounds):
        out = F.when(index <= upper, name).otherwise(out)
    return out


def templated(templates: dict[str, list[str]], family: Column, index: Column, slots: dict[str, Column]) -> Column:
    """The template of a family at ``index`` modulo their number, its ``{slot}`` filled in the order of ``slots``; null for families without templates."""
    lists = F.create_map(*(x for name, texts in templates.items() for x in (F.lit(name), F.array(*map(F.lit, texts)))))
    of = F.try_element_at(lists, family)
    text = F.try_element_at(of, (F.pmod(index, F.size(of)) + 1).cast("int"))
    for name, value in slots.items():
        text = F.replace(text, F.lit("{%s}" % name), F.coalesce(value.cast("string"), F.lit("")))
    return text


def reworded(text: Column, rules: list[tuple[str, str]], index: Column, opening: str, starters: list[str], blank: str, edges: str = " .!?,;", marks: str = ".!?") -> Column:
    """A request after a chain of patterns and replacements, in their order.

    Space becomes single, ``edges`` are cut off both ends; nothing left gives
    ``blank``.  A request that begins with ``opening`` takes the starter at
    ``index`` modulo their number instead.  A mark closes it.  Null stays null.
    """
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    text = F.trim(F.regexp_replace(text, r"\s+", " "), F.lit(edges))
    starter = F.element_at(F.array(*map(F.lit, starters)), (F.pmod(index, F.lit(len(starters))) + 1).cast("int"))
    text = F.when(text.startswith(opening), F.concat(starter, F.substr(text, F.lit(len(opening) + 1)))).otherwise(text)
    closed = F.when(F.lit(marks).contains(F.right(text, F.lit(1))), text).otherwise(F.concat(text, F.lit(marks[0])))
    return F.when(text == "", blank).otherwise(closed)


def without_names(text: Column, names: list[str], stand_in: str) -> Column:
    """Names of scenes give way to a stand-in."""
    for name in names:
        text = F.replace(text, F.lit(name), F.lit(stand_in))
    return text


def plain_catalog(json: Column, rules: list[tuple[str, str]]) -> Column:
    """A JSON list of assets with five fields each, without nulls, and paths that tell no name; entries that are no objects go."""
    entries = F.from_json(json, CATALOG)

    def plain(asset: Column) -> Column:
        path = F.coalesce(asset["path"], F.lit(""))
        for pattern, to in rules:
            path = F.regexp_replace(path, pattern, to)
        return F.struct(asset["id"].alias("id"), asset["type"].alias("type"), path.alias("path"), asset["origin"].alias("origin"), asset["exists"].alias("exists"))

    return F.coalesce(F.to_json(F.transform(F.filter(entries, lambda a: a.isNotNull()), plain)), F.lit("[]"))


def unchanged(before: DataFrame, after: DataFrame, key: str, json: str, allowed: DataFrame) -> DataFrame:
    """``(key, state)`` of outputs by their canonical JSON: ``same``, ``changed``, ``repaired`` (a change of a key in ``allowed``), ``lost`` or ``new``.

    Texts that are no JSON are compared as they stand.
    """
    return _compared(before, after, key, json, allowed).select(key, "state")


def _form(text: str | None) -> str:
    text = text or ""
    found = canonical_text(text)
    return text if found is None else found


@F.pandas_udf(BooleanType())
def _equal(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([a == b or _form(a) == _form(b) for a, b in zip(left, right, strict=True)], dtype=bool)


def _compared(before: DataFrame, after: DataFrame, key: str, json: str, allowed: DataFrame) -> DataFrame:
    """:func:`unchanged` with both texts, ``a_`` and ``b_``; only texts that differ are parsed."""
    a = before.select(key, F.col(json).alias("a_"), F.lit(True).alias("in_a"))
    b = after.select(key, F.col(json).alias("b_"), F.lit(True).alias("in_b"))
    may = allowed.select(key).distinct().withColumn("may", F.lit(True))
    rows = a.join(b, key, "full").join(may, key, "left").withColumn("differ", ~F.col("a_").eqNullSafe(F.col("b_")))
    asked = lambda text: F.when(F.col("differ"), F.col(text))
    same = ~F.col("differ") | _equal(asked("a_"), asked("b_"))
    state = F.when(F.col("in_b").isNull(), "lost").when(F.col("in_a").isNull(), "new").when(same, "same").when(F.col("may"), "repaired").otherwise("changed")
    return rows.select(key, state.alias("state"), "a_", "b_")


def first_reasons(found: DataFrame, key: str, ranks: list[str]) -> DataFrame:
    """``(key, reason)``: of several reasons the one that stands first in ``ranks``; others do not count."""
    place = F.array_position(F.array(*map(F.lit, ranks)), F.col("reason"))
    first = found.withColumn("place", place).where("place > 0").groupBy(key).agg(F.min("place").alias("place"))
    return first.select(key, F.element_at(F.array(*map(F.lit, ranks)), F.col("place").cast("int")).alias("reason"))


def natural_view(records: DataFrame, key: str, intent: Column, reasons: DataFrame, ranks: list[str], outputs: DataFrame, repairs: DataFrame, fixed: DataFrame, names: list[str], stand_in: str) -> DataFrame:
    """Records with plain requests: ``key, reason, intent, output, error``.

    ``reasons`` (``key``, ``reason``) drop a record, the first of ``ranks``
    counts.  A request is that of ``fixed`` (``key``, ``intent``) where there is
    one, else ``intent``; names of scenes go from either.  ``outputs`` (``key``,
    ``output``) are what records hold now; one that is not equal as JSON to the
    record's ``output`` is the error ``output_changed``, unless ``repairs`` has the
    key.  Dropped records have a reason and neither request nor error.  A record
    without a key or with a repeated one is not joined twice: keys of the three
    tables must be unique.
    """
    drop = first_reasons(reasons, key, ranks)
    state = _compared(records, outputs, key, "output", repairs).select(key, "state", F.col("b_").alias("now_"))
    rows = records.withColumn("intent_", intent).join(drop, key, "left").join(fixed.select(key, F.col("intent").alias("fixed_")), key, "left")
    rows = rows.drop("output").join(state, key, "left")
    kept = F.col("reason").isNull()
    said = without_names(F.coalesce("fixed_", "intent_"), names, stand_in)
    error = F.when(F.col("state").isin("changed", "lost"), F.concat(F.lit("output_"), "state"))
    return rows.select(key, "reason", F.when(kept, said).alias("intent"), F.when(kept, F.col("now_")).alias("output"), F.when(kept, error).alias("error"))


def view_counts(view: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """The manifest: retained and dropped records, those by reason, repaired and wrongly changed ones, in one row a reason (null: retained)."""
    may = repairs.select(key).distinct().withColumn("may", F.lit(True))
    return view.join(may, key, "left").groupBy("reason").agg(F.count("*").alias("records"), F.count_if(F.coalesce("may", F.lit(False))).alias("repaired"), F.count("error").alias("errors"), F.min(key).alias("first"))
