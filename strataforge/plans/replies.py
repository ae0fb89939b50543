"""Queries over replies in each form, built from labels; every rule is broken by some."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataforge.operators import replies


def _rows(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic")


def _dealt(base: str, faults: list[tuple], by: int) -> Column:
    """``base`` with the fault whose number is ``doc_id % by``; texts may hold the marks ``%N`` (the id modulo 11) and ``%Q`` (by quality)."""
    text = F.lit(base)
    for n, (old, new, *_) in enumerate(faults, 1):
        assert old in base
        text = F.when(F.col("doc_id") % by == n, F.lit(base.replace(old, new, 1))).otherwise(text)
    number = (F.col("doc_id") % 11).cast("string")
    return F.concat(F.lit("Here: "), F.replace(F.replace(text, F.lit("%N"), number), F.lit("%Q"), F.when(F.col("quality") == 1, "met").otherwise("unclear")), F.lit(" {done}"))


_DIMENSIONS = ", ".join(f'"{n}": {{"score": %N, "evidence": "e"}}' for n in replies.WEIGHTS)
SEMANTIC = f'{{"decision": "Pass", "confidence": 0.5, "requirements": [{{"requirement": "r", "verdict": "%Q", "evidence": "e"}}, {{"requirement": "q", "verdict": "met", "evidence": "f"}}], "dimensions": {{{_DIMENSIONS}}}}}'
_FIRST, _LAST = f'"{next(iter(replies.WEIGHTS))}": {{"score": %N, "evidence": "e"}}', '"scope_control": {"score": %N, "evidence": "e"}'
#: What is replaced by what, and the errors that follow.
SEMANTIC_FAULTS = [
    ('"Pass"', '"maybe"', "decision"), ("0.5", "true", "confidence"), ("0.5", '"0.5"', "confidence"), ("0.5", "1.5", "confidence"), ('"%Q"', '"so"', "verdicts"), ('"evidence": "f"', '"evidence": " "', "evidence"),
    (_LAST, '"other": {"score": 1, "evidence": "e"}', "dimensions,score:scope_control,evidence:scope_control"), (_FIRST, _FIRST.replace("%N", "11"), "score:requirement_coverage"), (_FIRST, _FIRST.replace('"e"', "null"), "evidence:requirement_coverage"),
    ('"verdict": "met"', '"verdict": "unmet"', ""), ('"dimensions": {', '"dimensions": [{', "no_json,decision,confidence,requirements,verdicts,evidence,dimensions," + ",".join(f"score:{n}" for n in replies.WEIGHTS) + "," + ",".join(f"evidence:{n}" for n in replies.WEIGHTS)),
]
REPAIR = '{"score": %N, "verdict": "fixed", "why": "w", "is_repair_better_than_original": true}'
REPAIR_FAULTS = [
    ("%N", '"4.5"', ""), ("%N", "12", "score"), ("%N", "[]", "score"), ('"fixed"', '"fine"', "verdict"), ('"w"', '" "', "why"), ('"why"', '"confidence": 2, "why"', "confidence"), ('"why"', '"remaining_issues": "x", "why"', "remaining_issues"),
    ('"why"', '"introduced_regressions": [], "needs_human_review": true, "why"', ""), ('"why"', '"introduced_regressions": null, "why"', "introduced_regressions"),
]
MODEL = '{"verdict": " fix", "confidence": 0.9, "reason": "r", "repaired_intent": "new", "repaired_asset_catalog": [{"id": "a", "type": "image"}]}'
MODEL_FAULTS = [
    ('" fix"', '"keep"', ""), ('" fix"', '"exclude"', ""), ('" fix"', '"drop"', "verdict"), ("0.9", "-1", "confidence"), ('"r"', '""', "reason"), ('"image"', "null", "asset_fields"), ('[{"id": "a", "type": "image"}]', '"a"', "assets"),
    ('[{"id": "a", "type": "image"}]', "null", ""), ('"new"', '" "', "content"), ('"reason"', '"issue_types": {}, "reason"', "issue_types"),
]


def semantic_replies(spark, d):
    rows = _rows(spark, d).withColumn("reply", _dealt(SEMANTIC, SEMANTIC_FAULTS, len(SEMANTIC_FAULTS) + 2))
    return replies.semantic_judgements(rows, "reply").select("doc_id", "score", "decision", "consistent", F.array_join("errors", ",").alias("errors"))


def repair_replies(spark, d):
    rows = _rows(spark, d).withColumn("reply", _dealt(REPAIR, REPAIR_FAULTS, len(REPAIR_FAULTS) + 2))
    return replies.repair_judgements(rows, "reply").select("doc_id", "score", "verdict", "confidence", "better", "human", F.array_join("errors", ",").alias("errors"))


def model_repairs(spark, d):
    rows = _rows(spark, d).withColumn("reply", _dealt(MODEL, MODEL_FAULTS, len(MODEL_FAULTS) + 2)).withColumn("i", F.lit("old")).withColumn("p", F.when(F.col("quality") == 1, "code")).withColumn("a", F.lit("[]"))
    out = replies.model_repairs(rows.drop("toxic"), "reply", "i", "p", "a")
    return out.select("doc_id", "action", "intent", "program", "assets", "reason", F.array_join("errors", ",").alias("errors"))


QUERIES = {f.__name__: f for f in (semantic_replies, repair_replies, model_repairs)}


def _errors(faults: list[tuple]) -> str:
    return f"(VALUES (0, ''), ({len(faults) + 1}, ''), {', '.join(f"({n}, '{e}')" for n, (*_, e) in enumerate(faults, 1))}) f(k, errors)"


_S, _R, _M = (len(x) + 2 for x in (SEMANTIC_FAULTS, REPAIR_FAULTS, MODEL_FAULTS))
SQL = {
    "semantic_replies": f"""WITH r AS (SELECT doc_id, doc_id % {_S} AS k, doc_id % 11 AS s, quality, errors FROM labels JOIN {_errors(SEMANTIC_FAULTS)} ON doc_id % {_S} = k),
        j AS (SELECT *, CASE WHEN errors = '' THEN CASE WHEN k = 10 OR s < 4 THEN 'fail' WHEN quality = 1 AND s >= 8 THEN 'pass' ELSE 'review' END END AS decision FROM r)
        SELECT doc_id, CASE WHEN errors = '' THEN s::DOUBLE END AS score, decision, decision = 'pass' AS consistent, errors FROM j""",
    "repair_replies": f"""SELECT doc_id, CASE k WHEN 1 THEN 4.5::DOUBLE WHEN 2 THEN 12 WHEN 3 THEN NULL ELSE doc_id % 11 END AS score, CASE k WHEN 4 THEN 'fine' ELSE 'fixed' END AS verdict, CASE k WHEN 6 THEN 2 ELSE 0 END::DOUBLE AS confidence,
        true AS better, k = 8 AS human, errors FROM labels JOIN {_errors(REPAIR_FAULTS)} ON doc_id % {_R} = k""",
    "model_repairs": f"""SELECT doc_id, CASE k WHEN 1 THEN 'KEEP' WHEN 2 THEN 'EXCLUDE' WHEN 3 THEN 'DROP' ELSE 'FIX' END AS action, CASE k WHEN 2 THEN NULL WHEN 9 THEN '' ELSE 'new' END AS intent, CASE WHEN k <> 2 THEN CASE WHEN quality = 1 THEN 'code' ELSE '' END END AS program,
        CASE k WHEN 2 THEN NULL WHEN 6 THEN '[{{"id":"a","type":null}}]' WHEN 7 THEN '"a"' WHEN 8 THEN '[]' ELSE '[{{"id":"a","type":"image"}}]' END AS assets, CASE k WHEN 1 THEN 'API KEEP: r' WHEN 5 THEN '' ELSE 'r' END AS reason,
        CASE WHEN k = 2 OR quality = 1 OR errors = 'content' THEN errors WHEN errors IN ('assets', 'asset_fields') THEN 'content,' || errors WHEN errors = '' THEN 'content' ELSE errors || ',content' END AS errors
        FROM labels JOIN {_errors(MODEL_FAULTS)} ON doc_id % {_M} = k""",
}
