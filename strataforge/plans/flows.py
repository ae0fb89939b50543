"""Queries over ordered rows, events, trees, contracts and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions import scalars
from strataforge.operators import events as ev
from strataforge.operators import ordered, rules, space, tree


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def latest_per_key(spark, d):
    return ordered.latest(_read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])


def upsert_merge(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return ordered.upsert(rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'"), "user_id", "event_id")


def best_per_group(spark, d):
    parts = _read(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return ordered.best_per_group(parts, ["p_brand"], [F.desc("p_retailprice"), F.desc("p_size"), F.col("p_partkey")])


def last_rows(spark, d):
    return _read(spark, d, "events").orderBy(F.desc("event_id")).limit(40).select("event_id", "event_type")


def second_page(spark, d):
    return ordered.page(_read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 2, 50)


def change_log(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return ordered.changes(rows, "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "old", "event_type")


def overwritten_rows(spark, d):
    return ordered.overwritten(_read(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


def until_failure(spark, d):
    return ordered.until_failure(_read(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "error")


def schedule_offsets(spark, d):
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("wait"))
    return ordered.schedule(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "wait"], "wait")


def next_level(spark, d):
    from pyspark.sql import Window

    return _read(spark, d, "orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next_order"))


def as_of_join(spark, d):
    rows = _read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    left = rows.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = rows.where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("last_click"))
    return ordered.as_of(left, right, "user_id", "ts", "last_click").select("event_id", "last_click")


def signal_edges(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return ev.signal_edges(rows.where("event_type = 'signup'").withColumnRenamed("user_id", "producer"), rows.where("event_type = 'purchase'").withColumnRenamed("user_id", "listener"), "day", "producer", "listener")


def unresolved_edges(spark, d):
    """Users' days: who signs up without an error that day, and the other way round."""
    rows = _read(spark, d, "events").withColumn("signal", F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    return ev.unresolved_signals(rows.where("event_type = 'signup'"), rows.where("event_type = 'error'"), "signal")


def debounce(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_id", "ts")
    return ev.debounce(rows, "user_id", "ts", 6 * 3_600_000, "event_id").select("user_id", "event_id")


def kv_fold(spark, d):
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "purchase", "add").otherwise("none")
    rows = _read(spark, d, "events").select("user_id", "event_id", op.alias("op"), F.col("value").cast("decimal(18,4)").alias("value"))
    return ev.fold(rows, "user_id", "event_id", "op", "value").select("user_id", F.round(F.col("value").cast("double"), 4).alias("value"), "ops")


def sessions_30m(spark, d):
    return ev.sessions(_read(spark, d, "events"), "user_id", "ts", "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def tumbling_day(spark, d):
    rows = _read(spark, d, "events")
    return rows.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding_hours(spark, d):
    rows = _read(spark, d, "events")
    return rows.groupBy(F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def queue_next_state(spark, d):
    tasks = _read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("new").alias("status"))
    return ev.queue_next_state(tasks, "attempts", "status", 3).select("o_orderkey", "next_state")


def enqueued_tasks(spark, d):
    """Orders as a queue, those of some customers asked for again, and those with a returned line done."""
    orders = _read(spark, d, "orders")
    tasks = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"), (F.col("o_orderkey") % 5).cast("int").alias("attempts"))
    done = _read(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ev.enqueued(tasks, orders.where("o_custkey % 2 = 0"), done, "o_orderkey")


def numeric_operations(spark, d):
    op = F.element_at(F.array(*(F.lit(x) for x in ("set", "add", "sub", "mul", "div", "none"))), (F.col("l_linenumber") % 6 + 1).cast("int"))
    by = F.when(F.col("l_suppkey") % 4 > 0, (F.col("l_suppkey") % 4 - 1).cast("double"))
    rows = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity").cast("double")).alias("x"), op.alias("op"), by.alias("y"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.applied(F.col("x"), F.col("op"), F.col("y")).alias("value"))


def moves(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    at = ev.running_since_reset(rows, "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("value")), F.col("value"))
    return at.select("event_id", F.round("position", 4).alias("position"))


def one_hot_choice(spark, d):
    rows = _read(spark, d, "lineitem")
    # the chosen place is on, all others are off
    hot = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.when(i == F.col("l_linenumber"), "1").otherwise("0")), "")
    return rows.select("l_orderkey", "l_linenumber", hot.alias("choice"))


def tag_strip(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(scalars.without_tags(F.col("html"))).alias("text_md5"))


def previews(spark, d):
    return _read(spark, d, "documents").select("doc_id", scalars.preview(F.col("text"), 3).alias("preview"))


def string_leaves(spark, d):
    rows = _read(spark, d, "events").where("props is not null")
    return tree.leaves(rows, "event_id", "props")


def tree_index(spark, d):
    """Orders as command trees of three levels, and the trees as rows again."""
    lines = _read(spark, d, "lineitem")
    leaf = F.struct(F.col("l_linenumber").alias("id"), F.lower("l_returnflag").alias("type"))
    inner = lines.groupBy("l_orderkey", "l_linestatus").agg(F.array_sort(F.collect_list(leaf)).alias("commands"))
    block = F.struct(F.col("l_linestatus").alias("id"), F.lit("if").alias("type"), F.struct(F.col("commands").alias("trueCommands")).alias("parameters"))
    trees = inner.groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(block)).alias("commands"))).alias("tree"))
    return tree.index_commands(trees, "l_orderkey", "tree").select("tree_key", "stream_key", "ordinal", "type", "depth")


def contract_errors(spark, d):
    lines = _read(spark, d, "lineitem")
    checked = rules.check(lines, {"quantity_range": F.col("l_quantity").between(1, 45), "discount_range": F.col("l_discount") <= 0.08, "flag_known": F.col("l_returnflag").isin("A", "N"), "price_positive": F.col("l_extendedprice") > 0})
    return rules.error_counts(checked)


def used_before_created(spark, d):
    rows = _read(spark, d, "events").select("user_id", "event_id", F.lit("account").alias("element"), "event_type")
    return rules.used_before_created(rows, "user_id", "event_id", "element", F.col("event_type") == "signup").select("event_id", "user_id")


def one_sided_users(spark, d):
    """Users' days with one of two kinds of events but not the other."""
    rows = _read(spark, d, "events").withColumn("user_day", F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    return rules.two_sided(rows, "user_day", F.col("event_type"), "signup", "error")


def _boxes(spark, d):
    dim = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    return _read(spark, d, "embeddings").select("vec_id", dim(1).alias("x"), dim(2).alias("y"))


def rect_overlap(spark, d):
    box = _boxes(spark, d)
    a = box.where("vec_id % 2 = 0").select("vec_id", "x", "y", (F.col("x") + 0.1).alias("x1"), (F.col("y") + 0.1).alias("y1"))
    b = box.where("vec_id % 2 = 1").select("vec_id", "x", "y", (F.col("x") + 0.1).alias("x1"), (F.col("y") + 0.1).alias("y1"))
    return space.overlaps(a, b, 0.25).select("left_id", "right_id", scalars.rounded(F.col("area"), 9).alias("area"))


def nearest_radius(spark, d):
    box = _boxes(spark, d)
    return space.nearest_within(box, box, 0.05).select("point_id", "target_id", F.round("away", 9).alias("away"))


QUERIES = {f.__name__: f for f in (latest_per_key, upsert_merge, best_per_group, last_rows, second_page, change_log, overwritten_rows, until_failure, schedule_offsets, next_level, as_of_join, signal_edges, unresolved_edges, debounce, kv_fold, sessions_30m, tumbling_day, sliding_hours, queue_next_state, enqueued_tasks, numeric_operations, moves, one_hot_choice, tag_strip, previews, string_leaves, tree_index, contract_errors, used_before_created, one_sided_users, rect_overlap, nearest_radius)}

SQL = {
    "latest_per_key": "SELECT user_id, ts, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_merge": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, event_id DESC) = 1",
    "best_per_group": "SELECT p_brand, p_partkey, p_retailprice, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) = 1",
    "last_rows": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 40",
    "second_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50",
    "change_log": "SELECT * FROM (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old, event_type FROM events) WHERE old IS DISTINCT FROM event_type",
    "overwritten_rows": "SELECT user_id, event_id, event_type FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = event_type",
    "until_failure": "SELECT user_id, event_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_id < e.event_id AND f.event_type = 'error')",
    "schedule_offsets": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS wait, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts_at FROM lineitem",
    "next_level": "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM orders",
    "as_of_join": "SELECT p.event_id, c.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts",
    "signal_edges": "SELECT DISTINCT a.user_id AS producer, a.ts::DATE AS day, b.user_id AS listener FROM events a JOIN events b ON a.ts::DATE = b.ts::DATE WHERE a.event_type = 'signup' AND b.event_type = 'purchase'",
    "unresolved_edges": """WITH e AS (SELECT user_id || '@' || ts::DATE AS signal, event_type FROM events), a AS (SELECT DISTINCT signal FROM e WHERE event_type = 'signup'), b AS (SELECT DISTINCT signal FROM e WHERE event_type = 'error')
        SELECT signal, 'not_heard' AS problem FROM a ANTI JOIN b USING (signal) UNION ALL SELECT signal, 'not_emitted' FROM b ANTI JOIN a USING (signal)""",
    "debounce": """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r(user_id, event_id, ms) AS (SELECT user_id, event_id, ms FROM o WHERE n = 1
          UNION ALL SELECT user_id, event_id, ms FROM (SELECT o.user_id, o.event_id, o.ms, row_number() OVER (PARTITION BY o.user_id ORDER BY o.ms, o.event_id) AS k FROM r JOIN o ON o.user_id = r.user_id AND o.ms >= r.ms + 21600000) WHERE k = 1)
        SELECT user_id, event_id FROM r""",
    "kv_fold": """WITH s AS (SELECT user_id, max(event_id) AS set_at, arg_max(value::DECIMAL(18,4), event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT user_id, round((coalesce(max(v), 0) + sum(CASE WHEN event_type = 'purchase' AND (set_at IS NULL OR event_id > set_at) THEN value::DECIMAL(18,4) ELSE 0 END))::DOUBLE, 4) AS value, count(*) AS ops FROM events LEFT JOIN s USING (user_id) GROUP BY 1""",
    "sessions_30m": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
        k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, s""",
    "tumbling_day": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_hours": "SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM events, range(2) t(k) GROUP BY 1",
    "queue_next_state": """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 5 < 3 THEN 'queued' ELSE 'failed' END ELSE 'queued' END AS next_state FROM orders""",
    "enqueued_tasks": """WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'done' END AS status, (o_orderkey % 5)::INT AS attempts FROM orders WHERE o_orderkey % 3 <> 0), a AS (SELECT DISTINCT o_orderkey, true AS asked FROM orders WHERE o_custkey % 2 = 0)
        SELECT coalesce(t.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN coalesce(t.o_orderkey, a.o_orderkey) IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) THEN 'done' WHEN status IS NULL OR asked AND status <> 'done' THEN 'queued' ELSE status END AS status,
        CASE WHEN asked AND status <> 'done' THEN 0 ELSE coalesce(attempts, 0) END::INT AS attempts FROM t FULL JOIN a ON t.o_orderkey = a.o_orderkey""",
    "numeric_operations": """WITH r AS (SELECT *, CASE WHEN l_partkey % 5 > 0 THEN l_quantity::DOUBLE ELSE 0 END AS x, CASE WHEN l_suppkey % 4 > 0 THEN (l_suppkey % 4 - 1)::DOUBLE ELSE 0 END AS y FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 6 WHEN 0 THEN y WHEN 1 THEN x + y WHEN 2 THEN x - y WHEN 3 THEN x * y WHEN 4 THEN CASE WHEN y = 0 THEN x ELSE x / y END ELSE x END::DOUBLE AS value FROM r""",
    "moves": """WITH e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS era FROM events)
        SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, era ORDER BY event_id), 4) AS position FROM e""",
    "one_hot_choice": "SELECT l_orderkey, l_linenumber, array_to_string(list_transform(range(1, 8), lambda i: CASE WHEN i = l_linenumber THEN '1' ELSE '0' END), '') AS choice FROM lineitem",
    "tag_strip": "SELECT page_id, md5(replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\r\n]+', ' ', 'g'), '=', '＝')) AS text_md5 FROM pages",
    "previews": "SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3], lambda x: trim(x)), ' / ') AS preview FROM documents",
    "string_leaves": "SELECT event_id, '$.' || key AS path, value::JSON ->> '$' AS value FROM (SELECT event_id, j.key, j.value FROM events, json_each(props) j)",
    "tree_index": """WITH b AS (SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus) - 1 AS k FROM b)
        SELECT l_orderkey AS tree_key, 'main' AS stream_key, k::INT AS ordinal, 'IF' AS type, 0 AS depth FROM o
        UNION ALL SELECT l_orderkey, 'main/' || k || '/trueCommands', (row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, lower(l_returnflag)) - 1)::INT, upper(l_returnflag), 1 FROM lineitem JOIN o USING (l_orderkey, l_linestatus)""",
    "contract_errors": """SELECT error, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT l_quantity BETWEEN 1 AND 45 THEN 'quantity_range' END, CASE WHEN l_discount > 0.08 THEN 'discount_range' END,
        CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag_known' END, CASE WHEN l_extendedprice <= 0 THEN 'price_positive' END], lambda x: x IS NOT NULL)) AS error FROM lineitem) GROUP BY 1""",
    "used_before_created": "SELECT event_id, user_id FROM events e WHERE event_type <> 'signup' AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'signup' AND f.event_id <= e.event_id)",
    "one_sided_users": "SELECT user_id || '@' || ts::DATE AS user_day, count(*) FILTER (event_type = 'signup') AS n_first, count(*) FILTER (event_type = 'error') AS n_second FROM events GROUP BY 1 HAVING (n_first > 0) <> (n_second > 0)",
    "rect_overlap": """WITH b AS (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings), r AS (SELECT vec_id, x, y, x + 0.1::DOUBLE AS x1, y + 0.1::DOUBLE AS y1 FROM b)
        SELECT l.vec_id AS left_id, r.vec_id AS right_id, round((least(l.x1, r.x1) - greatest(l.x, r.x)) * (least(l.y1, r.y1) - greatest(l.y, r.y)), 9) AS area
        FROM r l JOIN r ON l.vec_id % 2 = 0 AND r.vec_id % 2 = 1 AND l.x <= r.x1 AND r.x <= l.x1 AND l.y <= r.y1 AND r.y <= l.y1""",
    "nearest_radius": """WITH b AS (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings)
        SELECT point_id, target_id, round(away, 9) AS away FROM (SELECT p.vec_id AS point_id, t.vec_id AS target_id, sqrt((p.x-t.x)*(p.x-t.x) + (p.y-t.y)*(p.y-t.y)) AS away FROM b p JOIN b t ON p.vec_id <> t.vec_id)
        WHERE away < 0.05 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY away, target_id) = 1""",
}
