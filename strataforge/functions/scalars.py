"""Scalar expressions over columns; all of them stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789abcdef"


def _digit_sum(hexed: Column) -> Column:
    """Sum of the digits of a hex text."""
    return F.aggregate(F.split(hexed, ""), F.lit(0), lambda a, c: a + F.when(c != "", F.instr(F.lit(_DIGITS), c) - 1).otherwise(0))


def sha256_mod(text: Column, modulus: int) -> Column:
    """The 256-bit number of ``sha256(text)`` modulo 2, 5, 10 or 15.

    Powers of 16 leave 1 modulo 15 and 5, and 6 modulo 10, so digits suffice.
    """
    hexed = F.sha2(text, 256)
    last = F.instr(F.lit(_DIGITS), F.substring(hexed, 64, 1)) - 1
    if modulus == 2:
        return F.pmod(last, F.lit(2))
    if modulus in (5, 15):
        return F.pmod(_digit_sum(hexed), F.lit(modulus))
    if modulus == 10:
        return F.pmod(last + 6 * (_digit_sum(hexed) - last), F.lit(10))
    raise ValueError(f"no digit rule for modulus {modulus}")


def folded_name(name: Column) -> Column:
    """Trimmed, runs of white space and hyphens as one underscore, upper case."""
    return F.upper(F.regexp_replace(F.trim(name), r"[\s-]+", "_"))


def truthy(text: Column) -> Column:
    """Switch value of a text: empty, ``0`` and ``false`` are off, all others on; null stays null."""
    return ~F.lower(F.trim(text)).isin("", "0", "false")


def guarded_divide(current: Column, by: Column) -> Column:
    """Division that leaves the value as it is where the divisor is zero."""
    return F.when(by == 0, current).otherwise(current / by)


def applied(current: Column, op: Column, by: Column) -> Column:
    """A number after one operation: ``set``, ``add``, ``sub``, ``mul``, ``div``; missing numbers are 0, a division by zero and other operations change nothing."""
    x, y = F.coalesce(current, F.lit(0.0)), F.coalesce(by, F.lit(0.0))
    return F.when(op == "set", y).when(op == "add", x + y).when(op == "sub", x - y).when(op == "mul", x * y).when((op == "div") & (y != 0), x / y).otherwise(x)


def clamp_score(x: Column, low: float = 0, high: float = 10, places: int = 0) -> Column:
    """Cut to a range, ties of rounding to the even neighbour."""
    return F.bround(F.greatest(F.lit(low), F.least(F.lit(high), x)), places)


def without_tags(html: Column) -> Column:
    """Text of a fragment of HTML on one line, ``=`` widened so that it reads as text."""
    text = F.regexp_replace(html, "<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(text, "[\r\n]+", " "), "=", "＝")


def without_fence(text: Column) -> Column:
    """The inside of one fenced block, or the text itself."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^```[A-Za-z]*\\s*\\n", ""), "\\n```$", "")


def variable_names(text: Column) -> Column:
    """Names in braces that are not preceded by a dollar sign."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\$)\{([A-Za-z_]\w*)\}"), F.lit(1))


def preview(text: Column, lines: int = 8) -> Column:
    """First non-blank lines, trimmed, joined by `` / ``."""
    kept = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.concat_ws(" / ", F.transform(F.slice(kept, 1, lines), lambda x: F.trim(x)))


def nearest_rank(values: Column, q: float) -> Column:
    """Element ``ceil(n q) - 1`` of the sorted values."""
    at = F.greatest(F.ceil(F.size(values) * F.lit(q)).cast("int"), F.lit(1))
    return F.element_at(F.array_sort(values), at)


def rounded(x: Column, digits: int) -> Column:
    """``F.round`` of a double; only values near a tie, or large ones, become decimals on the way."""
    t = x * F.lit(10.0**digits)
    return F.when((F.abs(t) < 1e9) & (F.abs(t - F.floor(t) - 0.5) > 1e-3), F.floor(t + 0.5) / F.lit(10.0**digits)).otherwise(F.round(x, digits))
