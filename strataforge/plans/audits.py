"""Audit queries: ledgers in several states, coverage, shards, rewrites, zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators import report


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def review_states(spark, d):
    """A review decision and a repair give the next action of a document; contradictions are errors."""
    docs = _read(spark, d, "documents").select("doc_id", "lang")
    review = _read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "EXCLUDE").when(F.col("toxic") == 1, "FIX").otherwise("PASS").alias("decision"))
    repair = _read(spark, d, "labels").where("doc_id % 2 = 0 and toxic = 1").select("doc_id", F.lit(True).alias("repaired"))
    rows = docs.join(review, "doc_id", "left").join(repair, "doc_id", "left")
    action = F.when(F.col("decision").isNull(), "not_reviewed").when(F.col("decision") == "EXCLUDE", F.when(F.col("repaired"), "error_repaired_exclusion").otherwise("drop"))
    action = action.when(F.col("decision") == "FIX", F.when(F.col("repaired"), "use_repair").otherwise("error_missing_repair")).otherwise("keep")
    return rows.select("doc_id", action.alias("action"))


def coverage(spark, d):
    """Planned and finished work by batch, with what is missing."""
    plan = _read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).cast("int").alias("batch"))
    done = _read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(1))
    rows = plan.join(done, "o_orderkey", "left")
    return rows.groupBy("batch").agg(F.count("*").alias("planned"), F.count("done").alias("finished"), F.min(F.when(F.col("done").isNull(), F.col("o_orderkey"))).alias("first_missing"))


def hydrated(spark, d):
    """Generated items with the fields of their candidates; unknown ones are error rows."""
    made = _read(spark, d, "labels").select((F.col("doc_id") * 2).alias("doc_id"), "quality")
    known = _read(spark, d, "documents").select("doc_id", "source", F.lit(True).alias("known"))
    return made.join(known, "doc_id", "left").select("doc_id", "quality", "source", F.when(F.col("known").isNull(), "unknown_candidate").alias("error"))


def shard_check(spark, d):
    """Shards of a report must not overlap and must cover all keys."""
    keys = _read(spark, d, "customer").select("c_custkey")
    shards = keys.where("c_custkey % 3 = 0").withColumn("shard", F.lit(0)).unionByName(keys.where("c_custkey % 3 in (1, 2) and c_custkey % 50 <> 7").withColumn("shard", F.lit(1))).unionByName(keys.where("c_custkey % 30 = 0").withColumn("shard", F.lit(2)))
    seen = shards.groupBy("c_custkey").agg(F.count("*").alias("n"))
    both = keys.join(seen, "c_custkey", "left").where("n is null or n > 1")
    return both.select("c_custkey", F.when(F.col("n").isNull(), "missing").otherwise("twice").alias("problem"))


def repair_scores(spark, d):
    """Mean, smallest and rank percentiles of scores, and how many are low."""
    rows = _read(spark, d, "lineitem").select(F.col("l_returnflag").alias("verdict"), F.col("l_linenumber").cast("long").alias("score"))
    disc = lambda q: F.expr(f"cast(percentile_disc({q}) within group (order by score) as long)")
    return rows.groupBy("verdict").agg(F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("low"), disc(0.1).alias("p10"), disc(0.5).alias("p50"), disc(0.9).alias("p90"), F.count_if(F.col("score") < 3).alias("n_low"))


def run_summary(spark, d):
    """Passed runs, rates and latency by kind, with a total row."""
    rows = _read(spark, d, "events").select("event_type", "value", (F.col("event_type") != "error").alias("structural"), (F.col("value") > 10).alias("passed"))
    return report.summary_with_total(rows, "event_type", total=F.count("*"), passed=F.count_if("passed"), pass_rate=F.round(F.avg(F.col("passed").cast("int")), 4), latency=F.round(F.avg(F.col("value").cast("decimal(18,6)")).cast("double"), 4))


def common_valid(spark, d):
    """Cases that both of two runs finished validly, and who won them."""
    rows = _read(spark, d, "lineitem")
    side = lambda flag, name: rows.where(F.col("l_linestatus") == flag).groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias(name))
    both = side("O", "a").join(side("F", "b"), "l_orderkey")
    return both.select("l_orderkey", F.when(F.col("a") > F.col("b"), "a").when(F.col("a") < F.col("b"), "b").otherwise("tie").alias("winner"))


def points_in_zones(spark, d):
    """Centres inside zones, edges included; zones are a table of fixed size."""
    zones = spark.createDataFrame([(1, -0.05, -0.05, 0.05, 0.05), (2, 0.0, 0.0, 0.2, 0.1), (3, -0.3, -0.3, -0.1, 0.0)], "zone int, x0 double, y0 double, x1 double, y1 double")
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    points = _read(spark, d, "embeddings").select("vec_id", at(1).alias("x"), at(2).alias("y"))
    return points.join(F.broadcast(zones), F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select("vec_id", "zone")


def rewritten_variables(spark, d):
    """``${x}`` becomes ``{x}``, with the number of changes."""
    text = F.concat(F.lit("go ${"), "source", F.lit("} and ${"), "lang", F.lit("} or {"), F.col("lang"), F.lit("}"))
    rows = _read(spark, d, "documents").select("doc_id", text.alias("t"))
    return rows.select("doc_id", F.regexp_replace("t", r"\$\{(\w+)\}", "{$1}").alias("text"), F.regexp_count("t", F.lit(r"\$\{(\w+)\}")).cast("long").alias("changes"))


def augmented_assets(spark, d):
    """Three assets for each document from a ring of fifteen, from the place that its hash tells."""
    from strataforge.functions.scalars import sha256_mod

    start = sha256_mod(F.col("doc_id").cast("string"), 15)
    ring = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("anim_"), ((start + i) % 15).cast("int").cast("string")))
    return _read(spark, d, "documents").select("doc_id", F.array_join(ring, ",").alias("assets"))


# Words of the language that a task must not name.
LEAKS = r"(?iU)\b(VAR|IMAGE|TEXT|CLICK|SELECT|CHOICES|OPTION|WAIT|SIGNAL|AUTO|ON|SET_VARIABLE|SHOW_IMAGE|DSL|JSON|API)\b"


def leaking_tasks(spark, d):
    """Benchmark texts that read like implementation, or are too short or too long."""
    items = _read(spark, d, "benchmark")
    rows = items.select("item_id", F.col("text").rlike(LEAKS).alias("words"), F.length("text").between(8, 600).alias("fits"))
    return rows.select("item_id", F.array_join(F.array_compact(F.array(F.when(F.col("words"), "words"), F.when(~F.col("fits"), "length"))), ",").alias("problems"))


def input_rules(spark, d):
    """Form rules of a field: required, length, pattern; all that are broken."""
    name = F.col("c_name")
    broken = F.array_compact(F.array(F.when(F.trim(name) == "", "required"), F.when(~F.length(name).between(5, 20), "length"), F.when(~name.rlike("^Customer#[0-9]*[02468]$"), "pattern"), F.when(~F.col("c_acctbal").between(0, 9000), "range")))
    return _read(spark, d, "customer").select("c_custkey", F.array_join(broken, ",").alias("errors"))


def page_hosts(spark, d):
    """Pages by host: distinct paths without a trailing slash, the first page of each kept."""
    pages = _read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace("url", r"[/]+$", "").alias("path"))
    first = pages.groupBy("host", "path").agg(F.min("page_id").alias("page_id"))
    return first.groupBy("host").agg(F.count("*").alias("paths"), F.min("page_id").alias("first_page"))


def history_ring(spark, d):
    """The last hundred events of each type: what a ring of that size still holds."""
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return _read(spark, d, "events").withColumn("place", place).where("place <= 100").select("event_type", "event_id")


def worker_shards(spark, d):
    """Work by worker, a batch staying with its worker."""
    rows = _read(spark, d, "orders").select(F.col("o_orderkey"), F.pmod(F.floor(F.col("o_orderkey") / 25), F.lit(8)).cast("int").alias("worker"))
    return rows.groupBy("worker").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def stale_users(spark, d):
    """Users whose last purchase is more than a day before the newest of all."""
    rows = _read(spark, d, "events").where("event_type = 'purchase'")
    last = rows.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    newest = rows.agg(F.max("ts").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).where("last_ts < newest - interval 1 day").select("user_id", "last_ts")


def loop_until_break(spark, d):
    """Iterations that run: those up to and with the first that breaks."""
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("broke", F.coalesce(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(order), F.lit(0))).where("broke = 0").groupBy("l_orderkey").agg(F.count("*").alias("iterations"))


def selected_in_group(spark, d):
    """The selection that holds in each single-choice group: the last one made."""
    rows = _read(spark, d, "events").where("event_type = 'click'")
    return rows.groupBy(F.col("user_id").alias("group_id")).agg(F.max_by("value", "event_id").alias("selected"), (F.count("*") - 1).alias("cancelled"))


def listeners_per_event(spark, d):
    return _read(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("listeners"), F.count("*").alias("emitted"))


def kinds_of_files(spark, d):
    """Resource kinds from what pages link to."""
    links = _read(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r'(?:src|href)="([^"]+)"'), F.lit(1))).alias("link"))
    ext = F.lower(F.regexp_extract("link", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), "image").when(ext.isin("mp3", "ogg", "wav"), "audio").when(ext.isin("mp4", "webm"), "video").otherwise("other")
    return links.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def conversation_outline(spark, d) -> DataFrame:
    """Turns as an indented outline, answers one step in."""
    rows = _read(spark, d, "conversations")
    line = F.concat(F.when(F.col("role") == "assistant", "  ").otherwise(""), "role")
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"]), "\n").alias("outline"))


QUERIES = {f.__name__: f for f in (review_states, coverage, hydrated, shard_check, repair_scores, run_summary, common_valid, points_in_zones, rewritten_variables, augmented_assets, leaking_tasks, input_rules, page_hosts, history_ring, worker_shards, stale_users, loop_until_break, selected_in_group, listeners_per_event, kinds_of_files, conversation_outline)}

_SUM = "list_sum(list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda c: instr('0123456789abcdef', c) - 1))::BIGINT"
SQL = {
    "review_states": """SELECT doc_id, CASE WHEN quality IS NULL THEN 'not_reviewed' WHEN quality = 0 THEN CASE WHEN doc_id % 2 = 0 AND toxic = 1 THEN 'error_repaired_exclusion' ELSE 'drop' END
        WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'use_repair' ELSE 'error_missing_repair' END ELSE 'keep' END AS action FROM documents LEFT JOIN labels USING (doc_id)""",
    "coverage": """SELECT (o_orderkey % 10)::INT AS batch, count(*) AS planned, count(l_orderkey) AS finished, min(o_orderkey) FILTER (l_orderkey IS NULL) AS first_missing
        FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""",
    "hydrated": "SELECT l.doc_id * 2 AS doc_id, quality, source, CASE WHEN d.doc_id IS NULL THEN 'unknown_candidate' END AS error FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id * 2",
    "shard_check": """SELECT c_custkey, CASE WHEN n = 0 THEN 'missing' ELSE 'twice' END AS problem FROM (SELECT c_custkey, (c_custkey % 3 = 0)::INT + (c_custkey % 3 <> 0 AND c_custkey % 50 <> 7)::INT + (c_custkey % 30 = 0)::INT AS n FROM customer) WHERE n <> 1""",
    "repair_scores": """SELECT l_returnflag AS verdict, round(avg(l_linenumber), 4)::DOUBLE AS mean, min(l_linenumber)::BIGINT AS low, quantile_disc(l_linenumber, 0.1)::BIGINT AS p10, quantile_disc(l_linenumber, 0.5)::BIGINT AS p50,
        quantile_disc(l_linenumber, 0.9)::BIGINT AS p90, count(*) FILTER (l_linenumber < 3) AS n_low FROM lineitem GROUP BY 1""",
    "run_summary": """SELECT event_type, grouping(event_type)::INT AS is_total, count(*) AS total, count(*) FILTER (value > 10) AS passed, round(avg((value > 10)::INT), 4)::DOUBLE AS pass_rate,
        round((sum(value::DECIMAL(18,6)) / count(value))::DOUBLE, 4) AS latency FROM events GROUP BY GROUPING SETS ((event_type), ())""",
    "common_valid": """SELECT l_orderkey, CASE WHEN a > b THEN 'a' WHEN a < b THEN 'b' ELSE 'tie' END AS winner FROM (
        SELECT l_orderkey, sum(l_quantity::BIGINT) FILTER (l_linestatus = 'O') AS a, sum(l_quantity::BIGINT) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "points_in_zones": """WITH z(zone, x0, y0, x1, y1) AS (VALUES (1, -0.05, -0.05, 0.05, 0.05), (2, 0.0, 0.0, 0.2, 0.1), (3, -0.3, -0.3, -0.1, 0.0)), p AS (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings)
        SELECT vec_id, zone::INT AS zone FROM p JOIN z ON x BETWEEN x0::DOUBLE AND x1::DOUBLE AND y BETWEEN y0::DOUBLE AND y1::DOUBLE""",
    "rewritten_variables": "SELECT doc_id, 'go {' || source || '} and {' || lang || '} or {' || lang || '}' AS text, 2::BIGINT AS changes FROM documents",
    "augmented_assets": f"SELECT doc_id, 'anim_' || s % 15 || ',anim_' || (s + 1) % 15 || ',anim_' || (s + 2) % 15 AS assets FROM (SELECT doc_id, {_SUM} % 15 AS s FROM documents)",
    "leaking_tasks": r"""SELECT item_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{M}\p{N}_])(VAR|IMAGE|TEXT|CLICK|SELECT|CHOICES|OPTION|WAIT|SIGNAL|AUTO|ON|SET_VARIABLE|SHOW_IMAGE|DSL|JSON|API)([^\p{L}\p{M}\p{N}_]|$)') THEN 'words' END, CASE WHEN NOT length(text) BETWEEN 8 AND 600 THEN 'length' END], lambda x: x IS NOT NULL), ',') AS problems FROM benchmark""",
    "input_rules": """SELECT c_custkey, array_to_string(list_filter([CASE WHEN trim(c_name) = '' THEN 'required' END, CASE WHEN NOT length(c_name) BETWEEN 5 AND 20 THEN 'length' END,
        CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$') THEN 'pattern' END, CASE WHEN NOT c_acctbal BETWEEN 0 AND 9000 THEN 'range' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer""",
    "page_hosts": """SELECT host, count(*) AS paths, min(page_id) AS first_page FROM (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '[/]+$', '') AS path, min(page_id) AS page_id FROM pages GROUP BY 1, 2) GROUP BY 1""",
    "history_ring": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100",
    "worker_shards": "SELECT (o_orderkey // 25 % 8)::INT AS worker, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1",
    "stale_users": "SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING last_ts < (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 1 DAY",
    "loop_until_break": """SELECT l_orderkey, count(*) AS iterations FROM (SELECT l_orderkey, coalesce(max((l_returnflag = 'R')::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broke FROM lineitem) WHERE broke = 0 GROUP BY 1""",
    "selected_in_group": "SELECT user_id AS group_id, arg_max(value, event_id) AS selected, count(*) - 1 AS cancelled FROM events WHERE event_type = 'click' GROUP BY 1",
    "listeners_per_event": "SELECT event_type, count(DISTINCT user_id) AS listeners, count(*) AS emitted FROM events GROUP BY 1",
    "kinds_of_files": """SELECT CASE WHEN e IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'svg') THEN 'image' WHEN e IN ('mp3', 'ogg', 'wav') THEN 'audio' WHEN e IN ('mp4', 'webm') THEN 'video' ELSE 'other' END AS kind, count(*) AS n
        FROM (SELECT lower(regexp_extract(link, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM (SELECT unnest(regexp_extract_all(html, '(?:src|href)="([^"]+)"', 1)) AS link FROM pages)) GROUP BY 1""",
    "conversation_outline": "SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '  ' ELSE '' END || role, chr(10) ORDER BY turn, role) AS outline FROM conversations GROUP BY 1",
}
