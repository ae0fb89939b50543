"""Replies of judges and repairers in three forms: what they say, and every rule that they break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.assets import first_json

# The dimensions of a judgement and their weights.
WEIGHTS = {"requirement_coverage": 0.25, "behavioral_correctness": 0.25, "resource_grounding": 0.15, "interaction_feedback": 0.15, "layout_presentation": 0.10, "scope_control": 0.10}
#: A dimension below POOR fails a judgement, one below GOOD keeps it from passing; so does the weighted score.
POOR, GOOD = 4, 8
_NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"


def _at(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def _text(v: str, path: str) -> Column:
    """A value as trimmed text, empty where there is none."""
    return F.trim(F.coalesce(F.expr(f"try_variant_get({v}, '$.{path}', 'string')"), F.lit("")))


def _number(v: str, path: str, strict: bool = False) -> Column:
    """A number; ``strict``: only if it is written as one."""
    found = F.expr(f"try_variant_get({v}, '$.{path}', 'double')")
    return F.when(F.expr(f"schema_of_variant({_at(v, path)})").rlike(_NUMBER), found) if strict else found


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold, in order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))


def _list_or_none(v: str, path: str) -> Column:
    return F.expr(f"{_at(v, path)} is null") | F.expr(f"schema_of_variant({_at(v, path)})").startswith("ARRAY")


def _parsed(df: DataFrame, reply: str) -> DataFrame:
    return df.withColumn("v_", F.try_parse_json(first_json(F.col(reply))))


def pair_judgements(df: DataFrame, reply: str) -> DataFrame:
    """``winner`` (A, B or tie), ``confidence`` and ``errors`` of comparisons; a reason is due, and lists of faults must be lists."""
    lists = ("a_missing_requirements", "b_missing_requirements", "a_errors", "b_errors")
    rules = {"no_json": F.col("v_").isNotNull(), "winner": _text("v_", "winner").isin("A", "B", "tie"), "confidence": _number("v_", "confidence").between(0, 1), "reason": _text("v_", "reason") != ""} | {f: _list_or_none("v_", f) for f in lists}
    return _parsed(df, reply).select(*df.columns, _text("v_", "winner").alias("winner"), _number("v_", "confidence").alias("confidence"), _broken(rules).alias("errors"))


def repair_judgements(df: DataFrame, reply: str) -> DataFrame:
    """``score`` (0 to 10), ``verdict``, ``confidence`` (0 where absent), ``better``, ``human`` and ``errors`` of judged repairs."""
    confidence = F.when(F.expr(f"{_at('v_', 'confidence')} is null"), F.lit(0.0)).otherwise(_number("v_", "confidence"))
    flag = lambda f: F.coalesce(F.expr(f"try_variant_get(v_, '$.{f}', 'boolean')"), F.lit(False))
    rules = {"no_json": F.col("v_").isNotNull(), "score": _number("v_", "score").between(0, 10), "verdict": _text("v_", "verdict").isin("fixed", "partially_fixed", "bad"), "confidence": confidence.between(0, 1), "why": _text("v_", "why") != ""}
    rules |= {f: _list_or_none("v_", f) for f in ("remaining_issues", "introduced_regressions")}
    return _parsed(df, reply).select(
        *df.columns, _number("v_", "score").alias("score"), _text("v_", "verdict").alias("verdict"), confidence.alias("confidence"), flag("is_repair_better_than_original").alias("better"), flag("needs_human_review").alias("human"), _broken(rules).alias("errors"),
    )


def semantic_judgements(df: DataFrame, reply: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``score``, ``decision``, ``consistent`` and ``errors`` of judgements by requirement and dimension.

    The decision follows from what is judged: ``fail`` where a requirement is
    unmet or the score, or one of the first two dimensions, is below ``POOR``;
    ``pass`` where all are met and none of the three is below ``GOOD``; else
    ``review``.  ``consistent`` tells whether the judge said the same.  Replies
    with errors have neither.
    """
    said, asked = F.lower(_text("v_", "decision")), F.expr("try_variant_get(v_, '$.requirements', 'array<variant>')")
    rows = _parsed(df, reply).withColumn("asked_", asked)
    each = "transform(asked_, r -> struct(coalesce(try_variant_get(r, '$.verdict', 'string'), '') as verdict, trim(coalesce(try_variant_get(r, '$.requirement', 'string'), '')) as name, trim(coalesce(try_variant_get(r, '$.evidence', 'string'), '')) as evidence))"
    rows = rows.withColumn("asked_", F.expr(each))
    rounded = {n: F.bround(_number("v_", f"dimensions.{n}.score", strict=True), 3) for n in weights}
    keys = F.array_sort(F.json_object_keys(F.to_json(F.expr(_at("v_", "dimensions")))))
    rules = {
        "no_json": F.col("v_").isNotNull(), "decision": said.isin("pass", "review", "fail"), "confidence": _number("v_", "confidence", strict=True).between(0, 1), "requirements": F.size("asked_") > 0,
        "verdicts": F.forall("asked_", lambda r: r["verdict"].isin("met", "unmet", "unclear")), "evidence": F.forall("asked_", lambda r: (r["name"] != "") & (r["evidence"] != "")),
        "dimensions": keys == F.array(*(F.lit(n) for n in sorted(weights))),
    }
    rules |= {f"score:{n}": s.between(0, 10) for n, s in rounded.items()} | {f"evidence:{n}": _text("v_", f"dimensions.{n}.evidence") != "" for n in weights}
    rows = rows.withColumn("errors", _broken(rules))
    fine = F.size("errors") == 0
    score = F.bround(sum((s * F.lit(w) for (_, s), w in zip(rounded.items(), weights.values(), strict=True)), F.lit(0.0)), 3)
    rows = rows.withColumns({"said_": said, "low_": F.least(*list(rounded.values())[:2]), "score": F.when(fine, score)})
    verdicts = F.transform("asked_", lambda r: r["verdict"])
    failed = F.array_contains(verdicts, "unmet") | (F.least("score", "low_") < POOR)
    passed = F.forall(verdicts, lambda x: x == "met") & (F.least("score", "low_") >= GOOD)
    decision = F.when(fine, F.when(failed, "fail").when(passed, "pass").otherwise("review"))
    return rows.select(*df.columns, "score", decision.alias("decision"), F.when(fine, decision == F.col("said_")).alias("consistent"), "errors")


def model_repairs(df: DataFrame, reply: str, intent: str, program: str, assets: str) -> DataFrame:
    """``action`` (KEEP, FIX or EXCLUDE), the repaired ``intent``, ``program`` and ``assets`` (JSON), ``reason`` and ``errors``.

    What a reply leaves out stays as in the columns named; an exclusion needs a
    reason only.  ``assets`` must be a list of objects with an id and a type.
    """
    rows = _parsed(df, reply)
    verdict, reason = F.upper(_text("v_", "verdict")), _text("v_", "reason")
    confidence = F.when(F.expr(f"{_at('v_', 'confidence')} is null"), F.lit(0.0)).otherwise(_number("v_", "confidence"))
    new = lambda path, old: F.trim(F.coalesce(F.nullif(F.expr(f"try_variant_get(v_, '$.{path}', 'string')"), F.lit("")), F.col(old), F.lit("")))
    listed = F.expr(f"coalesce({_at('v_', 'repaired_asset_catalog')}, parse_json('null'))")
    given = F.schema_of_variant(listed) != "VOID"
    catalog = F.when(given, F.to_json(listed)).otherwise(F.coalesce(F.col(assets), F.lit("[]")))
    whole = F.expr("try_variant_get(try_parse_json(catalog_), '$', 'array<variant>')")
    filled = lambda a, f: F.trim(F.coalesce(F.try_variant_get(a, f"$.{f}", "string"), F.lit(""))) != ""
    out = F.lit(False) | (verdict == "EXCLUDE")
    rules = {
        "no_json": F.col("v_").isNotNull(), "verdict": verdict.isin("KEEP", "FIX", "EXCLUDE"), "confidence": confidence.between(0, 1), "issue_types": _list_or_none("v_", "issue_types"), "reason": reason != "",
        "content": out | ((new("repaired_intent", intent) != "") & (new("repaired_dsl", program) != "")), "assets": out | whole.isNotNull(),
        "asset_fields": out | F.coalesce(F.forall(whole, lambda a: filled(a, "id") & filled(a, "type")), F.lit(True)),
    }
    rows = rows.withColumn("catalog_", catalog).withColumn("errors", _broken(rules))
    kept = lambda c: F.when(~out, c)
    told = F.when(verdict == "KEEP", F.concat(F.lit("API KEEP: "), reason)).otherwise(reason)
    others = [c for c in df.columns if c not in (intent, program, assets)]
    return rows.select(*others, verdict.alias("action"), kept(new("repaired_intent", intent)).alias("intent"), kept(new("repaired_dsl", program)).alias("program"), kept(F.col("catalog_")).alias("assets"), told.alias("reason"), "errors")
