"""Queries over order statistics, resembling texts, script blocks and fragments of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators import ranks, segments, similar
from strataforge.plans import scenes


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def percentile_definitions(spark, d):
    """Lengths of documents by language, by four definitions of a percentile; a third of the rows share one length."""
    rows = _read(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 3 == 0, 200).otherwise(F.col("n_chars")).cast("double").alias("length"))
    wanted = {"p95_nearest": (ranks.nearest, 0.95), "p99_nearest": (ranks.nearest, 0.99), "p10_even": (ranks.half_even, 0.1), "p50_even": (ranks.half_even, 0.5), "p90_even": (ranks.half_even, 0.9), "p95_cut": (ranks.cut, 0.95), "median": ("median", 0.5)}
    return ranks.order_statistics(rows, ["lang"], "length", wanted)


def repair_judge_summary(spark, d):
    """Labelled documents as judged repairs: averages, order statistics, verdicts and the lowest scores by quality."""
    rows = _read(spark, d, "labels").select("doc_id", "quality", "toxic", (F.col("doc_id") * 7 % 41 / 4).alias("score"))
    low = (F.col("score") < 8) | (F.col("toxic") == 1)
    verdict = F.when(F.col("score") >= 8, "fixed").when(F.col("score") >= 6, "partially_fixed").otherwise("bad")
    counts = rows.withColumn("verdict", verdict).groupBy("quality").agg(
        F.round(F.avg("score"), 4).alias("average_score"), F.min("score").alias("min_score"), F.count_if(F.col("verdict") == "fixed").alias("fixed"), F.count_if(F.col("verdict") == "partially_fixed").alias("partially_fixed"), F.count_if(F.col("verdict") == "bad").alias("bad"),
        F.count_if(low).alias("needs_review"), F.count_if(F.col("score") < 8).alias("score_lt_8"), F.count_if(F.col("score") < 6).alias("score_lt_6"),
    )
    middle = ranks.order_statistics(rows, ["quality"], "score", {"p10_score": (ranks.half_even, 0.1), "median_score": (ranks.half_even, 0.5), "p90_score": (ranks.half_even, 0.9)})
    worst = ranks.lowest(rows, ["quality"], "score", "doc_id", low).withColumnRenamed("ids", "low_score_ids")
    return counts.join(middle, "quality").join(worst, "quality", "left").withColumnRenamed("n", "completed")


def load_test_summary(spark, d):
    """Events as calls of a load test with as many workers as the user's number has in its last digit, and their latencies."""
    rows = _read(spark, d, "events").select((F.col("user_id") % 4 + 1).alias("concurrency"), (F.col("event_type") == "error").alias("failed"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_id") * 31 % 997).cast("double").alias("latency"), (F.col("event_id") % 50).alias("tokens"))
    good = rows.where("not failed")
    latency = ranks.order_statistics(good, ["concurrency"], "latency", {"p50": ("median", 0.5), "p95": (ranks.cut, 0.95)}).drop("n")
    seconds = (F.max("ms") - F.min("ms")) / 1000
    totals = rows.groupBy("concurrency").agg(F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.round(F.count_if(~F.col("failed")) / seconds, 6).alias("rps"), F.round(F.sum(F.when(F.col("failed"), 0).otherwise(F.col("tokens"))) / seconds, 6).alias("tokens_per_second"))
    return totals.join(latency, "concurrency", "left")


def resembling_passages(spark, d):
    """Passages held out of the benchmark (each third) against the other ones, and shortened copies of all."""
    rows = _read(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text")
    kept = rows.where("item_id % 3 <> 0")
    part = rows.select((F.col("item_id") + 1_000_000).alias("item_id"), F.expr("substring(text, 1, cast(length(text) * 7 div 10 as int))").alias("text"))
    return similar.resembling(kept.unionByName(part), "item_id", rows.where("item_id % 3 = 0"), "item_id", "text").select("held", "row", "copies", F.round("ratio", 9).alias("ratio"))


def _scripts(spark, d) -> DataFrame:
    """Orders as scripts: three lines an order line, the second of them indented, some blank."""
    rows = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))).alias("x"))
    word = F.array(*(F.lit(w) for w in ("SHOW", "ON click", "WAIT 5", "SET v", "AUTO x", "NEXT", "SET w", "SHOW", "SET u", "SE bell", "TEXT t")))
    line = lambda s: F.concat_ws("\n", F.concat(F.element_at(word, (s["l_partkey"] % 11 + 1).cast("int")), F.lit(" "), s["l_partkey"].cast("string")), F.concat(F.lit("    INNER "), s["l_suppkey"].cast("string")), F.when(s["l_returnflag"] == "R", "").when(s["l_returnflag"] == "A", "  "), F.when(s["l_quantity"] > 25, "SET q"))
    return rows.select("l_orderkey", F.array_join(F.transform("x", line), "\n").alias("script"))


def script_blocks(spark, d):
    return segments.script_blocks(_scripts(spark, d), "l_orderkey", "script").select("l_orderkey", "block", "first_line", "n_lines", F.sha2("body", 256).alias("body_sha256"))


def tree_fragments(spark, d):
    """Levels taken apart, and the first of equal fragments."""
    found = segments.tree_fragments(scenes.levels(spark, d), "level_key", "level_json")
    return segments.distinct_fragments(found, "level_key").select("level_key", "suffix", "copies", F.expr("try_variant_get(try_parse_json(fragment), '$.id', 'string')").alias("id"))


def single_commands(spark, d):
    found = segments.single_commands(scenes.levels(spark, d), "level_key", "level_json", without=("WAIT",))
    return found.select("level_key", "number", "type")


QUERIES = {f.__name__: f for f in (percentile_definitions, repair_judge_summary, load_test_summary, resembling_passages, script_blocks, tree_fragments, single_commands)}

SQL = {
    "percentile_definitions": """WITH s AS (SELECT lang, list_sort(list((CASE WHEN doc_id % 3 = 0 THEN 200 ELSE n_chars END)::DOUBLE)) AS v, count(*) AS n FROM documents GROUP BY 1)
        SELECT lang, n, v[ceil(n * 0.95::DOUBLE)::BIGINT] AS p95_nearest, v[ceil(n * 0.99::DOUBLE)::BIGINT] AS p99_nearest, v[round_even((n - 1) * 0.1::DOUBLE, 0)::BIGINT + 1] AS p10_even, v[round_even((n - 1) * 0.5::DOUBLE, 0)::BIGINT + 1] AS p50_even,
          v[round_even((n - 1) * 0.9::DOUBLE, 0)::BIGINT + 1] AS p90_even, v[least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) + 1] AS p95_cut, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2 AS median FROM s""",
    "repair_judge_summary": """WITH r AS (SELECT doc_id, quality, toxic, (doc_id * 7 % 41) / 4::DOUBLE AS score FROM labels),
        s AS (SELECT quality, list_sort(list(score)) AS v, count(*) AS completed, round(avg(score), 4) AS average_score, min(score) AS min_score, count(*) FILTER (score >= 8) AS fixed, count(*) FILTER (score >= 6 AND score < 8) AS partially_fixed, count(*) FILTER (score < 6) AS bad,
            count(*) FILTER (score < 8 OR toxic = 1) AS needs_review, count(*) FILTER (score < 8) AS score_lt_8, count(*) FILTER (score < 6) AS score_lt_6 FROM r GROUP BY 1),
        w AS (SELECT quality, string_agg(doc_id::VARCHAR, ',' ORDER BY score, doc_id) AS low_score_ids FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY score, doc_id) AS k FROM r WHERE score < 8 OR toxic = 1) WHERE k <= 100 GROUP BY 1)
        SELECT quality, completed, average_score, min_score, fixed, partially_fixed, bad, needs_review, score_lt_8, score_lt_6, v[round_even((completed - 1) * 0.1::DOUBLE, 0)::BIGINT + 1] AS p10_score, v[round_even((completed - 1) * 0.5::DOUBLE, 0)::BIGINT + 1] AS median_score,
          v[round_even((completed - 1) * 0.9::DOUBLE, 0)::BIGINT + 1] AS p90_score, low_score_ids FROM s LEFT JOIN w USING (quality)""",
    "load_test_summary": """WITH r AS (SELECT user_id % 4 + 1 AS concurrency, event_type = 'error' AS failed, epoch_us(ts) // 1000 AS ms, (event_id * 31 % 997)::DOUBLE AS latency, event_id % 50 AS tokens FROM events),
        s AS (SELECT concurrency, list_sort(list(latency) FILTER (NOT failed)) AS v, count(*) AS requests, count(*) FILTER (failed) AS failures, count(*) FILTER (NOT failed) AS good, coalesce(sum(tokens) FILTER (NOT failed), 0) AS t, (max(ms) - min(ms)) / 1000::DOUBLE AS secs FROM r GROUP BY 1)
        SELECT concurrency, requests, failures, round(good / secs, 6) AS rps, round(t / secs, 6) AS tokens_per_second, (v[(good - 1) // 2 + 1] + v[good // 2 + 1]) / 2 AS p50, v[least(floor(good * 0.95::DOUBLE)::BIGINT, good - 1) + 1] AS p95 FROM s""",
    "script_blocks": """WITH RECURSIVE o AS (SELECT l_orderkey, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS k FROM lineitem),
        script AS (SELECT l_orderkey, string_agg(['SHOW', 'ON click', 'WAIT 5', 'SET v', 'AUTO x', 'NEXT', 'SET w', 'SHOW', 'SET u', 'SE bell', 'TEXT t'][p % 11 + 1] || ' ' || p || chr(10) || '    INNER ' || s || CASE f WHEN 'R' THEN chr(10) WHEN 'A' THEN chr(10) || '  ' ELSE '' END || CASE WHEN q > 25 THEN chr(10) || 'SET q' ELSE '' END, chr(10) ORDER BY k) AS t FROM o GROUP BY 1),
        ln AS (SELECT l_orderkey, i, x, trim(x) = '' AS blank, x NOT LIKE ' %' AS top FROM (SELECT l_orderkey, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS i FROM script)),
        full_ AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS k, coalesce(i - lag(i) OVER (PARTITION BY l_orderkey ORDER BY i) > 1, false) AS gap, x LIKE 'ON %' OR x LIKE 'AUTO %' OR x LIKE 'EVENT %' AS head,
            top AND (x LIKE 'NEXT%' OR x LIKE 'SCENE %' OR x LIKE 'BGM %' OR x LIKE 'BGM_STOP%' OR x LIKE 'SE %' OR x LIKE 'WAIT %') AS ending FROM ln WHERE NOT blank),
        step AS (SELECT l_orderkey, k, i, x, ending, 0 AS piece, 1 AS size FROM full_ WHERE k = 1
          UNION ALL SELECT n.l_orderkey, n.k, n.i, n.x, n.ending, CASE WHEN new THEN piece + 1 ELSE piece END, CASE WHEN new THEN 1 ELSE size + 1 END
          FROM (SELECT f.l_orderkey, f.k, f.i, f.x, f.ending, s.piece, s.size, f.gap OR s.ending OR (f.top AND (f.head OR s.size >= 8)) AS new FROM step s JOIN full_ f ON f.l_orderkey = s.l_orderkey AND f.k = s.k + 1) n),
        piece AS (SELECT l_orderkey, piece, count(*) AS n FROM step GROUP BY 1, 2),
        merged AS (SELECT l_orderkey, piece, (sum(CASE WHEN n > 2 OR piece = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY piece) - 1)::INT AS block FROM piece)
        SELECT l_orderkey, block, min(i)::INT AS first_line, count(*) AS n_lines, sha256(string_agg(x, chr(10) ORDER BY i)) AS body_sha256 FROM step JOIN merged USING (l_orderkey, piece) GROUP BY 1, 2""",
    "tree_fragments": scenes._LINES + """, frag AS (
            SELECT level_key, 'top' || (k + 1) AS suffix, 'c' || k AS id, CASE flag WHEN 'N' THEN 'if' || (q % 5 = 0) || q || '/' || CASE WHEN q % 11 = 0 THEN '' ELSE signal END WHEN 'R' THEN 'loop' || CASE WHEN q > 25 THEN 'set' WHEN q % 13 = 0 THEN 'wait' ELSE 'wait5' END ELSE CASE WHEN q % 7 = 0 THEN 'emit' || signal ELSE 'image' || p % 40 END END || '/' || k AS body
              FROM com WHERE stream_key = 'main'
            UNION ALL SELECT level_key, 'event1', 'ev', 'event' || p % 9 || '/' || s % 7 || '/' || p % 40 FROM ln WHERE k = 0 AND p % 3 <> 0
            UNION ALL SELECT level_key, 'event1-cmd1', 'm', 'm' || s % 7 FROM ln WHERE k = 0 AND p % 3 <> 0
            UNION ALL SELECT level_key, 'event1-cmd2', 'x', 'x' || p % 40 FROM ln WHERE k = 0 AND p % 3 <> 0)
        SELECT arg_min(level_key, (level_key, suffix)) AS level_key, arg_min(suffix, (level_key, suffix)) AS suffix, count(*) AS copies, min(id) AS id FROM frag GROUP BY body""",
    "single_commands": scenes._LINES + """, c AS (SELECT level_key, CASE WHEN type = 'SHOW_IMAGE' THEN 'SHOW-IMAGE' ELSE type END AS type, row_number() OVER (PARTITION BY level_key ORDER BY k, depth) AS number FROM com WHERE context <> 'event')
        SELECT level_key, number::INT AS number, type FROM c WHERE type <> 'WAIT'""",
}
