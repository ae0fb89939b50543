"""Queries over data sets for fine-tuning, and over values of commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions import values
from strataforge.operators import datasets as ds
from strataforge.plans.scenes import _saved

PROMPT = "Answer with a program."


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _view(spark, d):
    """Documents as candidates: long ones are verified, labels decide, and even flagged ones have a repair."""
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    labels = _read(spark, d, "labels")
    decisions = labels.select("doc_id", F.when(F.col("quality") == 0, "EXCLUDE").when(F.col("toxic") == 1, "FIX").otherwise("PASS").alias("decision"))
    repairs = labels.where("quality = 1 and toxic = 1 and doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("repaired "), "doc_id").alias("text"))
    view = ds.reviewed_view(docs, decisions, repairs, "doc_id", ["text"], F.col("n_chars") >= 300)
    return view.withColumn("split", ds.split_side(F.col("doc_id"), F.when(F.col("lang") == "de", "train"), 42))


def dataset_view(spark, d):
    return _view(spark, d).select("doc_id", "reason", "action", "split", F.sha2("text", 256).alias("text_sha256"))


def dataset_rows(spark, d):
    rows = ds.chat_rows(_view(spark, d), "doc_id", PROMPT, F.concat(F.lit("TASK\n"), "lang"), F.col("text"), 2)
    return rows.select("id", "source_id", "split", F.size("messages").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "|"), 256).alias("messages_sha256"))


def dataset_manifest(spark, d):
    return ds.manifest(_view(spark, d), "doc_id", F.col("n_chars"), F.length("text"))


def preflight_errors(spark, d):
    rows = _read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    return ds.preflight_errors(rows, "conv_id", "messages", ("user", "assistant", "user", "assistant"), PROMPT).select("conv_id", F.array_join("errors", ",").alias("errors"))


def episode_errors(spark, d):
    """Orders as episodes of four accepted lines, and the number that their priority claims."""
    lines = _read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "rejected").otherwise("accepted").alias("status"))
    claims = _read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 4).otherwise(3).alias("accepted_count"))
    return ds.episode_errors(lines, "l_orderkey", claims, 4)


def two_key_dedup(spark, d):
    """Documents in the order of their ids, new by length or by beginning."""
    rows = _read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 997).alias("plan"), F.substring(F.sha2("text", 256), 1, 2).alias("print"))
    return ds.first_by_two_keys(rows, "doc_id", "plan", "print", _saved).select("doc_id", "accepted")


def kv_operations(spark, d):
    """Five operations by event type; products sink below the smallest numbers."""
    op = F.element_at(F.create_map(*(F.lit(x) for x in ("signup", "set", "purchase", "add", "click", "mul", "view", "sub", "error", "div"))), F.col("event_type"))
    number = F.when(F.col("event_type") == "click", F.when(F.col("event_id") % 2 == 0, 1e-200).otherwise(0.3)).when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(2.0)).otherwise((F.col("event_id") % 8).cast("double"))
    rows = _read(spark, d, "events").select("user_id", "event_id", F.coalesce(op, F.lit("none")).alias("op"), number.alias("number"))
    return ds.fold_operations(rows, "user_id", "event_id", "op", "number")


def loop_rounds(spark, d):
    return ds.repeated(_read(spark, d, "part").select("p_partkey", "p_size"), F.col("p_size") % 4).select("p_partkey", "round")


def expression_values(spark, d):
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.create_map(F.lit("a"), F.col("l_partkey").cast("string"), F.lit("b"), F.col("l_linenumber").cast("string")).alias("v"))
    text = values.substituted(F.lit("${a} * (${gameState.b} - 3) + ${missing} / 2 + -1"), ["a", "b"], F.col("v"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.arithmetic(text).alias("value"))


def payload_arguments(spark, d):
    rows = _read(spark, d, "nation").select("n_nationkey", F.concat(F.lit("1, TRUE, 'x y', {n}, , {none}, -2.50, "), "n_name").alias("t"), F.create_map(F.lit("n"), F.col("n_regionkey").cast("string")).alias("v"))
    return rows.select("n_nationkey", F.array_join(values.payload(F.col("t"), F.col("v")), ",").alias("args"))


def plain_intents(spark, d):
    """Names of sources and languages, and numbered levels, give way to one stand-in."""
    text = F.concat(F.lit("In "), "source", F.lit(" level 3-2 "), "lang", F.lit(" show it"))
    anchors = F.array(F.col("source"), F.col("lang"), F.concat_ws(" ", F.lit("In"), "source"))
    return _read(spark, d, "documents").select("doc_id", values.normalized_intent(text, anchors, "HERE", [r"level\s*\d+(?:-\d+)?"]).alias("intent"))


QUERIES = {f.__name__: f for f in (dataset_view, dataset_rows, dataset_manifest, preflight_errors, episode_errors, two_key_dedup, kv_operations, loop_rounds, expression_values, payload_arguments, plain_intents)}

_LAST = "(instr('0123456789abcdef', right(h, 1)) - 1)"
_SUM = "list_sum(list_transform(string_split(h, ''), lambda c: instr('0123456789abcdef', c) - 1))"
_VIEW = f"""WITH dec AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'EXCLUDE' WHEN toxic = 1 THEN 'FIX' ELSE 'PASS' END AS decision, quality = 1 AND toxic = 1 AND doc_id % 3 <> 0 AS repaired FROM labels),
    j AS (SELECT doc_id, text, lang, n_chars, coalesce(decision, '') AS decision, coalesce(repaired, false) AS repaired, min(CASE WHEN n_chars >= 300 THEN doc_id END) OVER (PARTITION BY text) AS first, sha256('42:' || doc_id) AS h FROM documents LEFT JOIN dec USING (doc_id)),
    r AS (SELECT *, CASE WHEN n_chars < 300 THEN 'not_verified' WHEN doc_id <> first THEN 'duplicate' WHEN decision = 'EXCLUDE' THEN 'review_exclude' WHEN decision = 'FIX' AND NOT repaired THEN 'missing_repair' WHEN decision <> 'FIX' AND repaired THEN 'unasked_repair' END AS reason FROM j),
    v AS (SELECT doc_id, lang, n_chars, reason, CASE WHEN reason IS NULL THEN CASE WHEN decision = 'FIX' THEN 'FIX' ELSE 'KEEP' END END AS action,
        CASE WHEN lang = 'de' THEN 'train' WHEN ({_LAST} + 6 * ({_SUM} - {_LAST}))::BIGINT % 10 = 0 THEN 'validation' ELSE 'train' END AS split,
        CASE WHEN reason IS NULL AND repaired THEN 'repaired ' || doc_id ELSE text END AS text FROM r)
    """
SQL = {
    "dataset_view": _VIEW + "SELECT doc_id, reason, action, split, sha256(text) AS text_sha256 FROM v",
    "dataset_rows": _VIEW + f"SELECT doc_id || ':q' || q AS id, doc_id AS source_id, split, 3 AS n, sha256('system={PROMPT}|user=TASK' || chr(10) || lang || '|assistant=' || text) AS messages_sha256 FROM v, (VALUES (1), (2)) t(q) WHERE reason IS NULL",
    "dataset_manifest": _VIEW + """SELECT count(*) FILTER (reason IS NULL) AS source_groups, count(*) FILTER (reason IS NULL AND split = 'train') AS train_rows, count(*) FILTER (reason IS NULL AND split = 'validation') AS validation_rows, count(*) FILTER (reason IS NOT NULL) AS excluded_count,
        count(*) FILTER (action = 'FIX') AS repairs_applied, (sum(n_chars) FILTER (reason IS NULL))::BIGINT AS source_chars, (sum(length(text)) FILTER (reason IS NULL))::BIGINT AS chars, false AS group_leakage, round(1 - chars / source_chars, 6) AS reduction FROM v""",
    "preflight_errors": f"""SELECT conv_id, CASE WHEN roles = ['user', 'assistant', 'user', 'assistant'] THEN '' ELSE 'roles,' END || CASE WHEN first = '{PROMPT}' THEN '' ELSE 'prompt' END AS errors
        FROM (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text)[1] AS first FROM conversations GROUP BY 1)""",
    "episode_errors": """SELECT * FROM (SELECT coalesce(l_orderkey, o_orderkey) AS l_orderkey, array_to_string(list_filter([CASE WHEN coalesce(n, 0) <> 4 THEN 'records' END, CASE WHEN coalesce(ok, 0) <> coalesce(n, 0) THEN 'status' END, CASE WHEN coalesce(CASE WHEN o_orderkey IS NULL THEN -1 WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END, -1) <> 4 THEN 'claim' END], lambda x: x IS NOT NULL), ',') AS errors
        FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) s FULL JOIN orders ON l_orderkey = o_orderkey) WHERE errors <> ''""",
    "two_key_dedup": """WITH RECURSIVE t AS (SELECT doc_id, (n_chars % 997)::VARCHAR AS a, left(sha256(text), 2) AS b, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
        r AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, false AS accepted, []::VARCHAR[] AS sa, []::VARCHAR[] AS sb
          UNION ALL SELECT t.i, t.doc_id, NOT (list_contains(sa, a) OR list_contains(sb, b)), CASE WHEN list_contains(sa, a) OR list_contains(sb, b) THEN sa ELSE list_append(sa, a) END, CASE WHEN list_contains(sa, a) OR list_contains(sb, b) THEN sb ELSE list_append(sb, b) END FROM r JOIN t ON t.i = r.i + 1)
        SELECT doc_id, accepted FROM r WHERE i > 0""",
    "kv_operations": """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_type AS t, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 1e-200 ELSE 0.3::DOUBLE END WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 2.0 END ELSE event_id % 8 END::DOUBLE AS v FROM events),
        r AS (SELECT user_id, 0::BIGINT AS i, CASE WHEN t IN ('click', 'error') THEN 1.0 ELSE 0.0 END::DOUBLE AS x FROM e WHERE i = 1
          UNION ALL SELECT r.user_id, e.i, CASE e.t WHEN 'signup' THEN v WHEN 'purchase' THEN x + v WHEN 'view' THEN x - v WHEN 'click' THEN x * v WHEN 'error' THEN CASE WHEN v = 0 THEN x ELSE x / v END ELSE x END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
        SELECT user_id, arg_max(x, i) AS value FROM r GROUP BY 1""",
    "loop_rounds": "SELECT p_partkey, unnest(range(0, p_size % 4))::INT AS round FROM part",
    "expression_values": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey * (l_linenumber - 3) - 1)::VARCHAR AS value FROM lineitem",
    "payload_arguments": """SELECT n_nationkey, '1,true,"x y",' || n_regionkey || ',null,-2.50,"' || n_name || '"' AS args FROM nation""",
    "plain_intents": "SELECT doc_id, 'HERE show it' AS intent FROM documents",
}
