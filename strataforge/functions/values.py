"""Values of a command's parameters: variables, arithmetic, payloads, paths, intents.  Typed values are JSON texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMBER = r"^-?\d+(\.\d+)?$"


def coerced(text: Column) -> Column:
    """A plain text as JSON: numbers, truth values and null by their form, all else a string."""
    word = F.trim(text)
    return F.when(word.rlike(_NUMBER), word).when(F.lower(word).isin("true", "false", "null"), F.lower(word)).otherwise(_quoted(text))


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def resolved(text: Column, variables: Column) -> Column:
    """A text that is exactly ``{name}`` becomes the variable's JSON value with its type (null if there is none); other texts are strings."""
    name = F.trim(F.regexp_extract(text, r"^\{([^}]+)\}$", 1))
    return F.when(text.rlike(r"^\{[^}]+\}$"), F.try_element_at(variables, name)).otherwise(_quoted(text))


def payload(text: Column, variables: Column) -> Column:
    """A comma-separated payload as an array of JSON values; commas inside quotes part, too; empty entries go.

    ``variables`` maps names to JSON values.
    """
    tokens = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    inner = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)
    quoted = lambda t: (F.length(t) > 1) & ((F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'"))) | (F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))))
    return F.transform(tokens, lambda t: F.when(quoted(t), _quoted(inner(t))).when(t.rlike(r"^\{[^}]+\}$"), F.coalesce(resolved(t, variables), F.lit("null"))).otherwise(coerced(t)))


def normalized_intent(text: Column, anchors: Column, stand_in: str, patterns: list[str]) -> Column:
    """Names in ``anchors`` (an array) give way to ``stand_in``, longer ones first; so do matches of ``patterns``, and runs of stand-ins become one."""
    order = F.array_sort(F.array_distinct(F.filter(anchors, lambda a: F.coalesce(a, F.lit("")) != "")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    out = F.aggregate(order, text, lambda t, a: F.replace(t, a, F.lit(stand_in)))
    for p in patterns:
        out = F.regexp_replace(out, p, stand_in)
    one = re.escape(stand_in)
    return F.regexp_replace(out, rf"{one}(?:\s*{one})+", stand_in)


def arithmetic(expression: Column) -> Column:
    """Value of an expression of numbers, ``+ - * /`` and brackets; the text itself if it is none, or divides by zero.  Texts go to Python in Arrow batches."""
    return F.udf(evaluated, StringType(), useArrow=True)(expression)


def evaluated(expression: str | None) -> str | None:
    if expression is None:
        return None
    source = re.sub(r"\s+", "", expression)
    tokens = re.findall(r"\d+\.?\d*|\.\d+|[-+*/()]", source)
    if "".join(tokens) != source or not tokens:
        return expression
    at = 0

    def factor() -> float:
        nonlocal at
        t, at = tokens[at], at + 1
        if t in "+-":
            return factor() if t == "+" else -factor()
        if t == "(":
            value = total()
            if tokens[at] != ")":
                raise ValueError
            at += 1
            return value
        return float(t)

    def product() -> float:
        nonlocal at
        value = factor()
        while at < len(tokens) and tokens[at] in "*/":
            sign, at = tokens[at], at + 1
            value = value * factor() if sign == "*" else value / factor()
        return value

    def total() -> float:
        nonlocal at
        value = product()
        while at < len(tokens) and tokens[at] in "+-":
            sign, at = tokens[at], at + 1
            value = value + product() if sign == "+" else value - product()
        return value

    def whole() -> float:
        value = total()
        if at != len(tokens):
            raise ValueError
        return value

    try:
        value = whole()
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return expression
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def substituted(text: Column, names: list[str], variables: Column) -> Column:
    """``${name}`` becomes the variable's value, 0 where there is none; a leading ``gameState.`` is not part of the name."""
    out = F.regexp_replace(text, r"\$\{\s*(?:gameState\.)?([^}]*?)\s*\}", "\\${$1}")
    for n in names:
        out = F.replace(out, F.lit("${" + n + "}"), F.coalesce(F.try_element_at(variables, F.lit(n)), F.lit("0")))
    return F.regexp_replace(out, r"\$\{[^}]*\}", "0")
