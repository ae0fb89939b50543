"""Queries over catalogs, replies and event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.operators import assets

CATEGORIES = [("shouting", r"[A-Z]{6,}!"), ("table", r" \| "), ("marked", r"[#$%&*]{3}"), ("licence", "(?i)licensed under|released under")]


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def wait_for_purchase(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    out = assets.waits(rows, "user_id", "ms", F.col("event_type"), "click", "purchase", 86_400_000)
    return out.select("event_id", (F.col("ended_ms") - F.col("ms")).alias("waited_ms"))


def drops_from_outside(spark, d):
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "drop")
    rows = _read(spark, d, "events").select("user_id", "event_id", kind.alias("kind"), (F.col("value") > 10).alias("inside"))
    return assets.drops_from_outside(rows, "user_id", "event_id", F.col("kind"), F.col("inside")).select("user_id", "event_id")


def event_assertions(spark, d):
    wanted = spark.createDataFrame([("click", "at_least", 1), ("purchase", "exactly", 3), ("crash", "never", 0), ("error", "never", 0)], "event string, test string, n long")
    return assets.assertions(_read(spark, d, "events"), "event_type", wanted).select("event", "test", "seen", "passed")


def text_categories(spark, d):
    return _read(spark, d, "documents").groupBy(assets.category(F.col("text"), CATEGORIES).alias("category")).agg(F.count("*").alias("n"))


def headings(spark, d):
    at = lambda i: F.element_at("embedding", i).cast("double")
    return _read(spark, d, "embeddings").select("vec_id", assets.heading(at(1), at(2)).alias("heading"))


def trailing_numbers(spark, d):
    return _read(spark, d, "customer").select("c_custkey", assets.trailing_number(F.col("c_name")).alias("number"))


def filled_templates(spark, d):
    rows = _read(spark, d, "documents")
    values = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return rows.select("doc_id", assets.interpolated(F.lit("{lang} text of {source}, {other}"), values).alias("line"))


def judge_replies(spark, d):
    """Replies built from labels, some of them fenced or broken, read back and checked."""
    rows = _read(spark, d, "labels")
    body = F.concat(F.lit('{"winner": "'), F.when(F.col("quality") == 1, "A").otherwise("C"), F.lit('", "confidence": 0.5, "scores": {"fidelity": '), F.col("doc_id") % 12, F.lit(', "structure": 5, "overall": 7}}'))
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```\n"))).when(F.col("doc_id") % 3 == 1, body).otherwise("no verdict")
    out = assets.judgements(rows.select("doc_id", reply.alias("reply")), "reply")
    return out.select("doc_id", "winner", F.array_join("errors", ",").alias("errors"))


def catalog_ids(spark, d):
    """Order lines as assets of an order, with ids that never collide."""
    rows = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.lower("l_returnflag"))).alias("names"))
    return rows.select("l_orderkey", F.array_join(assets.greedy_ids(F.col("names")), ",").alias("ids"))


QUERIES = {f.__name__: f for f in (wait_for_purchase, drops_from_outside, event_assertions, text_categories, headings, trailing_numbers, filled_templates, judge_replies, catalog_ids)}

SQL = {
    "wait_for_purchase": """SELECT event_id, ended - ms AS waited_ms FROM (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms,
        min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 0 PRECEDING AND 86400000 FOLLOWING) AS ended FROM events) WHERE event_type = 'click'""",
    "drops_from_outside": """SELECT user_id, event_id FROM (SELECT *, last_value(CASE WHEN event_type = 'click' THEN value > 10 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS began FROM events)
        WHERE event_type = 'purchase' AND began <> (value > 10)""",
    "event_assertions": """SELECT event, test, count(event_type) AS seen, CASE test WHEN 'at_least' THEN count(event_type) >= n WHEN 'exactly' THEN count(event_type) = n ELSE count(event_type) = 0 END AS passed
        FROM (VALUES ('click', 'at_least', 1), ('purchase', 'exactly', 3), ('crash', 'never', 0), ('error', 'never', 0)) w(event, test, n) LEFT JOIN events ON event_type = event GROUP BY event, test, n""",
    "text_categories": """SELECT CASE WHEN regexp_matches(text, '[A-Z]{6,}!') THEN 'shouting' WHEN regexp_matches(text, ' \\| ') THEN 'table' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'marked'
        WHEN regexp_matches(text, '(?i)licensed under|released under') THEN 'licence' ELSE 'other' END AS category, count(*) AS n FROM documents GROUP BY 1""",
    "headings": """SELECT vec_id, CASE WHEN abs(x) > abs(y) THEN CASE WHEN x > 0 THEN 'right' ELSE 'left' END ELSE CASE WHEN y > 0 THEN 'down' ELSE 'up' END END AS heading FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)""",
    "trailing_numbers": "SELECT c_custkey, coalesce(try_cast(nullif(regexp_extract(c_name, '([0-9]{3})$', 1), '') AS INT), 1) AS number FROM customer",
    "filled_templates": "SELECT doc_id, lang || ' text of ' || source || ', {other}' AS line FROM documents",
    "judge_replies": """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN quality = 1 THEN 'A' ELSE 'C' END AS winner, CASE WHEN doc_id % 3 = 2 THEN 'no_json,winner,confidence,fidelity,structure,overall'
        ELSE array_to_string(list_filter([CASE WHEN quality <> 1 THEN 'winner' END, CASE WHEN doc_id % 12 > 10 THEN 'fidelity' END], lambda x: x IS NOT NULL), ',') END AS errors FROM labels""",
    "catalog_ids": """SELECT l_orderkey, string_agg(CASE WHEN k = 1 THEN f ELSE f || '_' || k END, ',' ORDER BY f, k) AS ids FROM (SELECT l_orderkey, lower(l_returnflag) AS f, row_number() OVER (PARTITION BY l_orderkey, l_returnflag) AS k FROM lineitem) GROUP BY 1""",
}
