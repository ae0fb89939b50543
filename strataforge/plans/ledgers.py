"""Queries over review ledgers, logs with deletions, repaired views and examples of coordination."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.operators import ledgers
from strataforge.plans import scenes
from strataforge.sources.shared import saved


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.concat(F.lit("task "), F.col("doc_id") % 9).alias("intent"), F.sha1("text").alias("program"))


def review_machine(spark, d):
    """Labels as decisions of five kinds, and repairs that miss, repeat or empty what they should change."""
    m = F.col("doc_id") % 13
    status = F.when(m == 0, "PASS").when(m == 1, "EXCLUDE").when(m.isin(2, 3, 4, 5), "QUERY_FIX").when(m.isin(6, 7, 8, 9), "DSL_FIX").when(m == 12, "MAYBE").otherwise("BOTH_FIX")
    labels = _read(spark, d, "labels").select("doc_id", m.alias("m"))
    decisions = labels.select("doc_id", status.alias("status"))
    intent = F.when(F.col("m").isin(2, 10, 11), F.concat(F.lit(" new "), "doc_id")).when(F.col("m") == 3, F.concat(F.lit("task "), F.col("doc_id") % 9, F.lit(" "))).when(F.col("m") == 4, " ")
    program = F.when(F.col("m").isin(6, 10), "code").when(F.col("m") == 7, "")
    repairs = labels.where("m not in (1, 8) and (m > 0 or doc_id % 2 = 0)").select("doc_id", intent.alias("intent"), program.alias("program"))
    return ledgers.reviewed(_documents(spark, d), decisions, repairs, "doc_id")


def verdicts_after_clearing(spark, d):
    """Events as a review log: errors clear what was said before."""
    log = _read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "clear").otherwise(F.col("event_type")).alias("verdict"))
    return ledgers.current_verdicts(log, "user_id", "event_id", "verdict")


def merged_ledger(spark, d):
    """Events as two ledgers of users: the second overrides, keys keep their first place."""
    rows = _read(spark, d, "events").select("user_id", "event_id", "event_type")
    return ledgers.merged_ledger(rows.where("event_type = 'signup'"), rows.where("event_type = 'error'"), "user_id", "event_id")


def augmented_animations(spark, d):
    """Documents with up to five assets, some of them animations of the ring already."""
    n = (F.col("doc_id") % 6).cast("int")
    given = F.slice(F.array(*(F.struct(F.lit(f"a{i}").alias("id"), F.lit("Animation" if i % 2 else "image").alias("type"), F.lit(f"anim_{i}").alias("path")) for i in range(5))), F.lit(1), n)
    ring = [f"anim_{i}" for i in range(15)]
    out = ledgers.augmented(given, F.col("doc_id"), ring, 3)
    return _read(spark, d, "documents").select("doc_id", F.array_join(F.transform(out, lambda a: F.concat_ws("=", a["id"], a["path"])), ",").alias("assets"))


def _recheck(spark, d):
    base = _documents(spark, d).where("doc_id % 17 <> 3")
    labels = _read(spark, d, "labels").select("doc_id", "quality", "toxic")
    recheck = labels.select("doc_id", F.when(F.col("quality") == 0, "STILL_BAD").when(F.col("toxic") == 1, "EXCLUDED").otherwise("FIXED").alias("verdict"), F.lit("r").alias("reason"))
    action = F.when(F.col("doc_id") % 5 == 0, "EXCLUDE").when(F.col("doc_id") % 23 == 1, "KEEP").otherwise("FIX")
    required = labels.where("quality = 0 and doc_id % 11 <> 2 or doc_id % 29 = 4").select("doc_id", action.alias("action"), F.when(F.col("doc_id") % 7 > 0, "why").alias("reason"), F.lit(None).cast("string").alias("intent"), F.when(F.col("doc_id") % 13 > 0, " mended ").alias("program"))
    extra = labels.where("doc_id % 19 = 1").select((F.col("doc_id") - F.when(F.col("doc_id") % 2 == 0, 5_000_000).otherwise(0)).alias("doc_id"), F.lit("FIX").alias("action"), F.lit("more").alias("reason"), F.lit("other").alias("intent"), F.lit("extra").alias("program"))
    return base, recheck, required, extra


def recheck_pending(spark, d):
    base, recheck, _, _ = _recheck(spark, d)
    return ledgers.recheck_pending(base, recheck, "doc_id").select("doc_id", "intent", "audit_reason", "status")


def recheck_problems(spark, d):
    return ledgers.recheck_problems(*_recheck(spark, d), "doc_id")


def rechecked_view(spark, d):
    base, _, required, extra = _recheck(spark, d)
    return ledgers.rechecked_view(base, required, extra, base.where("doc_id % 10 = 0"), "doc_id", ["intent", "program"])


def coordination_examples(spark, d):
    return ledgers.coordination_examples(scenes.levels(spark, d), "level_key", "level_json", saved)


QUERIES = {f.__name__: f for f in (review_machine, verdicts_after_clearing, merged_ledger, augmented_animations, recheck_pending, recheck_problems, rechecked_view, coordination_examples)}

_RECHECK = """WITH base AS (SELECT doc_id, 'task ' || doc_id % 9 AS intent, sha1(text) AS program FROM documents WHERE doc_id % 17 <> 3), bad AS (SELECT doc_id FROM labels WHERE quality = 0),
    req AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'EXCLUDE' WHEN doc_id % 23 = 1 THEN 'KEEP' ELSE 'FIX' END AS action, CASE WHEN doc_id % 7 > 0 THEN 'why' END AS reason, CASE WHEN doc_id % 13 > 0 THEN 'mended' END AS program FROM labels WHERE quality = 0 AND doc_id % 11 <> 2 OR doc_id % 29 = 4),
    ext AS (SELECT doc_id - CASE WHEN doc_id % 2 = 0 THEN 5000000 ELSE 0 END AS doc_id FROM labels WHERE doc_id % 19 = 1)
    """
SQL = {
    "review_machine": """WITH x AS (SELECT d.doc_id, 'task ' || d.doc_id % 9 AS intent, sha1(text) AS program, d.doc_id % 13 AS m, l.doc_id IS NOT NULL AS seen FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
        e AS (SELECT *, CASE WHEN NOT seen THEN 'not_reviewed' WHEN m = 12 THEN 'status' WHEN m = 0 AND doc_id % 2 = 0 THEN 'repaired_pass' WHEN m = 8 THEN 'missing_repair' WHEN m = 5 THEN 'missing_intent' WHEN m IN (9, 11) THEN 'missing_program' WHEN m = 3 THEN 'same_intent' WHEN m IN (4, 7) THEN 'empty' END AS error FROM x)
        SELECT doc_id, CASE WHEN error IS NULL AND m IN (2, 10) THEN 'new ' || doc_id ELSE intent END AS intent, CASE WHEN error IS NULL AND m IN (6, 10) THEN 'code' ELSE program END AS program, error IS NULL AND m <> 1 AS kept, error FROM e""",
    "verdicts_after_clearing": "SELECT user_id, verdict, event_id FROM (SELECT user_id, event_id, event_type AS verdict FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE verdict <> 'error'",
    "merged_ledger": """WITH r AS (SELECT *, CASE event_type WHEN 'signup' THEN 0 ELSE 1 END AS side FROM events WHERE event_type IN ('signup', 'error'))
        SELECT user_id, min(side)::INT AS rank_of, min(event_id) FILTER (side = low) AS first_place, CASE WHEN max(side) = 1 THEN 'error' ELSE 'signup' END AS event_type FROM (SELECT *, min(side) OVER (PARTITION BY user_id) AS low FROM r) GROUP BY user_id""",
    "augmented_animations": """WITH a AS (SELECT doc_id, doc_id % 6 AS n, list_transform(range(doc_id % 6)::BIGINT[], lambda i: 'a' || i || '=anim_' || i) AS given, sha256('animation:' || doc_id) AS h FROM documents),
        s AS (SELECT *, (list_reduce(list_transform(range(0, 64), lambda i: (strpos('0123456789abcdef', substr(h, i::INT + 1, 1)) - 1)::BIGINT), lambda acc, x: (acc * 16 + x) % 15)) % 15 AS start FROM a),
        o AS (SELECT doc_id, given, greatest(3 - least(n, 5) // 2, 0) AS need, list_filter(list_transform(range(15), lambda i: {'i': i, 'p': (start + i) % 15}), lambda x: x.p >= least(n, 5)) AS free FROM s)
        SELECT doc_id, array_to_string(list_concat(given, list_transform(free[1:need], lambda x: 'injected_animation_' || (x.i + 1) || '=anim_' || x.p)), ',') AS assets FROM o""",
    "recheck_pending": _RECHECK + "SELECT doc_id, intent, 'r' AS audit_reason, 'PENDING' AS status FROM base JOIN bad USING (doc_id)",
    "recheck_problems": _RECHECK + """SELECT doc_id, 'recheck' AS ledger, 'not_in_base' AS problem FROM bad ANTI JOIN base USING (doc_id)
        UNION ALL SELECT doc_id, 'required', 'missing' FROM bad ANTI JOIN req USING (doc_id) UNION ALL SELECT doc_id, 'required', 'not_asked_for' FROM req ANTI JOIN bad USING (doc_id) UNION ALL SELECT doc_id, 'extra', 'not_in_base' FROM ext ANTI JOIN base USING (doc_id)
        UNION ALL SELECT doc_id, 'required', 'action' FROM req WHERE action = 'KEEP' UNION ALL SELECT doc_id, 'required', 'no_reason' FROM req WHERE reason IS NULL UNION ALL SELECT doc_id, 'required', 'no_program' FROM req WHERE action = 'FIX' AND program IS NULL""",
    "rechecked_view": _RECHECK + """SELECT doc_id, action, CASE WHEN e THEN 'other' ELSE intent END AS intent, CASE WHEN e THEN 'extra' ELSE coalesce(fix, program) END AS program, reason, CASE WHEN action <> 'EXCLUDE' THEN CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END END AS split
        FROM (SELECT b.doc_id, b.intent, b.program, x.doc_id IS NOT NULL AS e, r.program AS fix, CASE WHEN x.doc_id IS NOT NULL THEN 'more' ELSE r.reason END AS reason,
          CASE WHEN x.doc_id IS NOT NULL THEN 'FIX' WHEN r.doc_id IS NULL THEN 'KEEP' WHEN r.action = 'EXCLUDE' THEN 'EXCLUDE' ELSE 'FIX' END AS action FROM base b LEFT JOIN req r USING (doc_id) LEFT JOIN ext x USING (doc_id))""",
    "coordination_examples": scenes._LINES + """, edge AS (SELECT level_key, arg_min(CASE context WHEN 'event' THEN 'event' ELSE 'main' END, (CASE context WHEN 'event' THEN 1 ELSE 0 END, k)) AS producer, min(signal) AS signal FROM (SELECT e.*, c.k FROM emit e JOIN com c USING (level_key, command_key)) JOIN hear USING (level_key, signal) GROUP BY 1)
        SELECT level_key, 1 AS number, CASE WHEN edge.signal IS NULL THEN 'independent_signal_listener' ELSE 'signal_routed_event' END AS pattern, producer, edge.signal AS signal, 'ev' AS consumer FROM hear LEFT JOIN edge USING (level_key)
        UNION ALL SELECT level_key, n, 'derived_event_generalization', NULL, NULL, 'ev' FROM hear, (VALUES (2), (3), (4)) v(n)""",
}
