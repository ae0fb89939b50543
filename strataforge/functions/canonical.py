"""JSON texts: strict validity, and one canonical form for equal values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def is_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value, with nothing but white space around it; null for a null text.

    Spark's parsers stop after the first value.  So the text is read as the first
    entry of a list whose second entry is the text's own MD5, which no text can
    hold: the list has just these two entries only if the text is one value.
    ``NaN`` and infinities count as numbers, a repeated key is no error.
    """
    mark = F.md5(text)
    found = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", {"allowSingleQuotes": "false"})
    return F.when(text.isNotNull(), F.coalesce((F.size(found) == 2) & (F.get(found, F.lit(1)) == mark) & ~F.trim(text).startswith(","), F.lit(False)))


def strict_variant(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else null."""
    return F.when(is_json(text), F.try_parse_json(text))


def canonical_text(text: str) -> str | None:
    """The value's text with sorted keys and no spaces; of a repeated key the last value counts."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _slowly(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical_text(t))


#: Texts that may hold a number with a point, an exponent, a minus before a zero or over 37 digits, a key for which
#: Java's and Unicode's order differ, or a control character with a letter in its code; Spark writes these in another form.
_ODD = r"[0-9][.eE]|-0|[0-9]{38}|NaN|Infinity|[\x{E000}-\x{FFFF}]|[\x{10000}-\x{10FFFF}]|\\u[d-fD-F]|\\u00[01][a-fA-F]"


def canonical(text: Column, spaced: bool = False) -> Column:
    """One text for equal JSON values: keys sorted at every depth, no spaces, characters unescaped.

    ``spaced`` puts a space after each comma and colon outside strings.  Numbers
    keep their kind: ``1`` and ``1.0`` differ, ``1.50`` and ``1.5`` do not.  Null
    where the text is not exactly one JSON value.  VARIANT sorts keys as it
    parses; only texts with numbers or keys that it writes differently, or with
    repeated keys, are rewritten in Arrow batches.
    """
    fine = is_json(text)
    fast = F.to_json(F.try_parse_json(F.when(~text.rlike(_ODD), text)))
    compact = F.when(fine, F.coalesce(fast, _slowly(F.when(fine & fast.isNull(), text))))
    # a run of strings and other characters, and the separator after it, each where the last one ended
    return F.regexp_replace(compact, r'\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:])', "$1$2 ") if spaced else compact


def canonical_hash(text: Column, spaced: bool = False) -> Column:
    """SHA-256 of :func:`canonical`."""
    return F.sha2(canonical(text, spaced), 256)
