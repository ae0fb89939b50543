"""Report and summary queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions import scalars
from strataforge.operators import report


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def type_distribution(spark, d):
    return report.distribution(_read(spark, d, "events"), "event_type", "user_id")


def two_key_counts(spark, d):
    return report.two_key_counts(_read(spark, d, "events"), "event_type", "user_id")


def state_counts(spark, d):
    return report.state_counts(_read(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


def top_messages(spark, d):
    lines = _read(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return report.top_messages(lines, "line", 20)


def length_report(spark, d):
    return report.percentiles(_read(spark, d, "documents"), "n_chars", "lang")


def over_limit(spark, d):
    docs = _read(spark, d, "documents")
    return docs.where(F.col("n_chars") > 20_000).select("doc_id", "n_chars")


def label_agreement(spark, d):
    docs = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("n_clean"), share(F.col("quality") != F.col("toxic")).alias("differ_share"))


def grouping_sets_summary(spark, d):
    docs = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return report.summary_with_total(docs, "lang", n=F.count("*"), good=F.count_if(F.col("quality") == 1), mean_chars=F.round(F.avg("n_chars"), 4))


def cube_summary(spark, d):
    docs = _read(spark, d, "documents")
    return docs.cube("lang", "source").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def judge_votes(spark, d):
    return report.votes(_read(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")


def weighted_scores(spark, d):
    lines = _read(spark, d, "lineitem")
    score = report.weighted_score({"l_quantity": 0.5, "l_discount": 0.3, "l_tax": 0.2})
    decision = F.when(F.col("score") >= 20, "accept").when(F.col("score") >= 10, "review").otherwise("reject")
    scored = lines.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))
    return scored.select("l_orderkey", "l_linenumber", "score", decision.alias("decision"))


def reduction_ratio(spark, d):
    pages = _read(spark, d, "pages")
    return pages.agg(F.count("*").alias("n"), F.round(1 - F.sum(F.length(scalars.without_tags(F.col("html")))) / F.sum(F.length("html")), 6).alias("reduction"))


def pricing_summary(spark, d):
    money = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    lines = _read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(money(F.col("l_quantity")).alias("sum_qty"), money(F.col("l_extendedprice")).alias("sum_price"), F.count("*").alias("n"))


def revenue_by_nation(spark, d):
    """A chain of joins that Catalyst orders; the two small tables are of fixed size."""
    price = (F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(18,2)")))
    rows = _read(spark, d, "lineitem").join(_read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(price).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


def word_counts_distinct(spark, d):
    docs = _read(spark, d, "documents")
    return docs.groupBy("source").agg(F.count_distinct("text").alias("texts"), F.count_distinct("lang").alias("langs"), F.max("n_chars").alias("longest"))


QUERIES = {f.__name__: f for f in (type_distribution, two_key_counts, state_counts, top_messages, length_report, over_limit, label_agreement, grouping_sets_summary, cube_summary, judge_votes, weighted_scores, reduction_ratio, pricing_summary, revenue_by_nation, word_counts_distinct)}

SQL = {
    "type_distribution": """
        WITH k AS (SELECT event_type, count(*) n, count(DISTINCT user_id) g FROM events GROUP BY 1)
        SELECT row_number() OVER (ORDER BY n DESC, event_type)::INT AS rank, event_type, n, round(100.0*n/(sum(n) OVER ()), 3)::DOUBLE AS share_percent, g AS groups_using,
               round(100.0*g/(SELECT count(DISTINCT user_id) FROM events), 3)::DOUBLE AS coverage_percent FROM k""",
    "two_key_counts": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2",
    "state_counts": "SELECT s.state, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(state) LEFT JOIN orders ON o_orderstatus = s.state GROUP BY 1",
    "top_messages": "SELECT line AS message, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1 ORDER BY n DESC, message LIMIT 20",
    "length_report": "SELECT lang, count(*) AS n, min(n_chars) AS low, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS high FROM documents GROUP BY 1",
    "over_limit": "SELECT doc_id, n_chars FROM documents WHERE n_chars > 20000",
    "label_agreement": """SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND toxic = 0) AS n_clean,
        round(avg(CASE WHEN quality <> toxic THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS differ_share FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    "grouping_sets_summary": """SELECT lang, grouping(lang)::INT AS is_total, count(*) AS n, count(*) FILTER (quality = 1) AS good, round(avg(n_chars), 4)::DOUBLE AS mean_chars
        FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())""",
    "cube_summary": "SELECT lang, source, grouping(lang, source)::INT AS level, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY CUBE (lang, source)",
    "judge_votes": """SELECT l_orderkey, n, mean, deviation, CASE WHEN lo = hi AND deviation <= 1.0 THEN lo ELSE 'review' END AS decision FROM (
        SELECT l_orderkey, count(*) AS n, round(avg(l_linenumber), 4)::DOUBLE AS mean, round(stddev_pop(l_linenumber), 4)::DOUBLE AS deviation, min(l_returnflag) AS lo, max(l_returnflag) AS hi
        FROM lineitem GROUP BY 1)""",
    "weighted_scores": """SELECT l_orderkey, l_linenumber, score, CASE WHEN score >= 20 THEN 'accept' WHEN score >= 10 THEN 'review' ELSE 'reject' END AS decision
        FROM (SELECT l_orderkey, l_linenumber, round(0.0::DOUBLE + 0.5::DOUBLE*l_quantity + 0.3::DOUBLE*l_discount + 0.2::DOUBLE*l_tax, 6) AS score FROM lineitem)""",
    "reduction_ratio": """SELECT count(*) AS n, round(1 - sum(length(replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\r\n]+', ' ', 'g'), '=', '＝'))) / sum(length(html)), 6)::DOUBLE AS reduction FROM pages""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "revenue_by_nation": """SELECT r_name, n_name, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE, 2) AS revenue, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "word_counts_distinct": "SELECT source, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs, max(n_chars) AS longest FROM documents GROUP BY 1",
}
