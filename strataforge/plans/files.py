"""Queries that write tables as text and read them again, and that read tables from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions import scalars
from strataforge.operators import assets, tree
from strataforge.operators import commands as c
from strataforge.sources import files, sinks
from strataforge.sources.shared import folder as _folder


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def jsonl_round_trip(spark, d):
    """Documents as JSON lines in two writes, read with a schema that a broken line would fail."""
    path = _folder(spark, "jsonl")
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang")
    sinks.jsonl(docs.where("doc_id % 2 = 0"), path)
    sinks.jsonl(docs.where("doc_id % 2 = 1"), path, append=True)
    return files.jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", "lang", F.sha2("text", 256).alias("text_sha256"))


def jsonl_absent(spark, d):
    """A path that does not exist counts as empty, beside one that does."""
    path = _folder(spark, "jsonl")
    sinks.jsonl(_read(spark, d, "nation").select("n_nationkey", "n_name"), path)
    schema = "n_nationkey int, n_name string"
    return files.jsonl(spark, path, schema, missing_ok=True).unionByName(files.jsonl(spark, path + "-none", schema, missing_ok=True))


def jsonl_broken_lines(spark, d):
    """Lines by whether they are JSON: names of some nations are written without their closing quote, or with a second value behind, blank lines between."""
    path = _folder(spark, "lines")
    line = F.concat(F.lit('{"n": "'), "n_name", F.when(F.col("n_nationkey") % 4 == 0, "").when(F.col("n_nationkey") % 5 == 0, '"} {"n": 1}').when(F.col("n_nationkey") % 7 == 0, '"} junk').otherwise('"}'), F.when(F.col("n_nationkey") % 3 == 0, "\n  ").otherwise(""))
    _read(spark, d, "nation").select(line.alias("value")).coalesce(1).write.text(path)
    return files.line_counts(files.jsonl_lines(spark, path)).select("n_valid", "n_invalid")


def torn_tails(spark, d):
    """Files of lines whose last one may be cut short: that one goes, broken lines before it stay."""
    orders = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))).alias("x"))
    line = lambda s: F.concat(F.lit('{"p":'), s["l_partkey"].cast("string"), F.when(s["l_returnflag"] == "R", "").when((s["l_returnflag"] == "A") & (s["l_quantity"] > 40), '}{"p":1}').otherwise("}"))
    text = orders.select(F.col("l_orderkey").alias("file"), F.array_join(F.transform("x", line), "\n").alias("text"))
    kept = files.without_torn_tail(files.numbered_lines(text, "file", "text"), "line")
    return kept.groupBy("file").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"))


def tsv_round_trip(spark, d):
    path = _folder(spark, "tsv")
    rows = _read(spark, d, "nation").select("n_nationkey", F.replace("n_name", F.lit("A"), F.lit("\t")).alias("n_name"))
    sinks.tsv(rows, path)
    return spark.read.option("header", True).option("sep", "\t").schema("n_nationkey int, n_name string").csv(path)


def csv_round_trip(spark, d):
    path = _folder(spark, "csv")
    sinks.csv(_read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return spark.read.option("header", True).schema("s_suppkey long, s_name string, s_nationkey int").csv(path)


def routed_round_trip(spark, d):
    """Documents in folders by what becomes of them, in one pass, and how many each folder holds."""
    path = _folder(spark, "routed")
    route = F.when(F.col("n_chars") < 200, "excluded").when(F.col("lang") == "en", "accepted").otherwise("keep")
    sinks.routed(_read(spark, d, "documents").select("doc_id", "lang", "n_chars"), path, route)
    return spark.read.schema("doc_id long, route string").json(path).groupBy("route").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def manifest_counts(spark, d):
    """A manifest written under a second name first, and read as a document."""
    path = _folder(spark, "manifest") + ".json"
    text = sinks.manifest(_read(spark, d, "documents"), {"rows": F.count("*"), "languages": F.count_distinct("lang"), "chars": F.sum("n_chars")})
    sinks.write_text(spark, path, text)
    get = lambda n: F.expr(f"variant_get(record, '$.{n}', 'long')").alias(n)
    return files.documents(spark, path).select(get("rows"), get("languages"), get("chars"))


def markdown_report(spark, d):
    """Events by type as a Markdown table."""
    text = sinks.markdown(_read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"])
    return spark.createDataFrame([(text,)], "report string")


def markdown_tables(spark, d):
    """A table of nations below a heading for each region, and its rows with their headings."""
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    region = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = region.groupBy("r_regionkey", "r_name").agg(F.concat(F.lit("## "), F.col("r_name"), F.lit("\n\n| key | name |\n|---|---|\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n")).alias("text"))
    rows = files.markdown_rows(text, "r_regionkey", "text").where("cells[0] <> 'key'")
    return rows.select("r_regionkey", "heading", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


def fenced_contents(spark, d):
    text = F.concat(F.lit("Before\n```json\n"), F.to_json(F.struct("n_nationkey", "n_name")), F.lit("\n```\nand\n```\n"), "n_name", F.lit("\n```"))
    return files.fenced_blocks(_read(spark, d, "nation").select("n_nationkey", text.alias("t")), "n_nationkey", "t")


def env_settings(spark, d):
    """Settings lines: quotes come off, comments go, the last of a key counts."""
    text = F.concat(F.lit("# KEY=no\nexport KEY='"), "n_name", F.lit("'\nNUMBER="), F.col("n_nationkey").cast("string"), F.lit("\nNUMBER = \""), F.col("n_regionkey").cast("string"), F.lit('"\nnothing'))
    return files.env_rows(_read(spark, d, "nation").select("n_nationkey", text.alias("t")), "n_nationkey", "t")


def settings_documents(spark, d):
    """Modifier settings: documents that are no objects have none."""
    text = F.when(F.col("n_nationkey") % 3 == 0, F.lit("[1]")).when(F.col("n_nationkey") % 3 == 1, F.lit('{"k"')).otherwise(F.concat(F.lit('{"k":"'), "n_name", F.lit('"}')))
    found = files.settings_or_null(_read(spark, d, "nation").select("n_nationkey", text.alias("t")), "n_nationkey", "t")
    return found.select(F.col("file").alias("n_nationkey"), F.expr("try_variant_get(settings, '$.k', 'string')").alias("k"))


def variable_reads(spark, d):
    """Names in braces that a text reads; those after a dollar sign are not meant."""
    text = F.concat(F.lit("{a_1} ${b} {"), "lang", F.lit("} {1x} {"), "source", F.lit("}"))
    return _read(spark, d, "documents").select("doc_id", F.array_join(scalars.variable_names(text), ",").alias("names"))


def folded_names(spark, d):
    return _read(spark, d, "part").select("p_partkey", scalars.folded_name(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" - ")), F.lit(" "))).alias("name"))


def asset_catalogs(spark, d):
    """One catalog from the four lists of an order's assets; the last entry of an id wins."""
    lines = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_partkey") % 5).alias("k"), F.col("l_suppkey").alias("s"))
    entry = F.concat(F.lit('{"name":"a'), F.col("k"), F.lit('","src":"f/'), "s", F.lit('.png"}'))
    part = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct("l_linenumber", "s", entry.alias("e"))))), lambda x: x["e"]), ",")
    docs = lines.groupBy("l_orderkey").agg(F.concat(F.lit('{"images":['), part("A"), F.lit('],"audios":['), part("N"), F.lit("]}")).alias("doc"))
    return assets.flattened(docs, "l_orderkey", "doc").select("l_orderkey", "id", "type", "path")


def variable_kinds(spark, d):
    """Kind and mode of each user's variable from its writes."""
    rows = _read(spark, d, "events").select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("place"), F.when(F.col("event_type") == "click", "true").when(F.col("event_type") == "purchase", F.col("value").cast("string")).otherwise("text").alias("value"), F.when(F.col("event_type") == "error", "add").otherwise("set").alias("operation"), F.when(F.col("event_type") == "signup", "global").otherwise("temp").alias("scope"))
    return c.variable_types(rows)


def script_parents(spark, d):
    """Orders as indented scripts: an order's lines below their status, and each line's parent."""
    lines = _read(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.concat(F.lit("if "), F.col("l_linestatus"), F.lit("\n    show "), F.array_join(F.array_sort(F.collect_list(F.col("l_partkey").cast("string"))), "\n    show ")).alias("part"))
    text = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("part")), "\n").alias("text"))
    rows = tree.script_lines(text, "l_orderkey", "text")
    return rows.groupBy("l_orderkey", "head", "depth").agg(F.count("*").alias("n"), F.sum(F.coalesce("parent", F.lit(-1))).alias("parents"))


def json_sizes(spark, d):
    """Estimated bytes of documents' records."""
    record = F.to_json(F.struct(F.col("doc_id").alias("id"), F.struct("lang", F.array(F.col("n_chars"), F.lit(2)).alias("n")).alias("of")))
    return tree.memory_estimates(_read(spark, d, "documents").select("doc_id", record.alias("j")), "doc_id", "j")


def path_edits(spark, d):
    """A value set by its path, and taken out again with the parents that this empties."""
    rows = _read(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"a":{"k":'), F.col("n_nationkey").cast("string"), F.lit("}}")).alias("j"))
    new = tree.with_path(rows, "n_nationkey", "j", "b.c", 1)
    gone = tree.with_path(new, "n_nationkey", "json", "a.k", None).withColumnRenamed("json", "without")
    return new.join(gone, "n_nationkey")


QUERIES = {f.__name__: f for f in (jsonl_round_trip, jsonl_absent, jsonl_broken_lines, torn_tails, tsv_round_trip, csv_round_trip, routed_round_trip, manifest_counts, markdown_report, markdown_tables, fenced_contents, env_settings, settings_documents, variable_reads, folded_names, asset_catalogs, variable_kinds, script_parents, json_sizes, path_edits)}

SQL = {
    "jsonl_round_trip": "SELECT doc_id, lang, sha256(text) AS text_sha256 FROM documents",
    "jsonl_absent": "SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation",
    "jsonl_broken_lines": "SELECT count(*) FILTER (n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0) AS n_valid, count(*) FILTER (n_nationkey % 4 = 0 OR n_nationkey % 5 = 0 OR n_nationkey % 7 = 0) AS n_invalid FROM nation",
    "torn_tails": """WITH o AS (SELECT l_orderkey, l_returnflag = 'R' OR l_returnflag = 'A' AND l_quantity > 40 AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_returnflag DESC) AS back FROM lineitem)
        SELECT l_orderkey AS file, count(*) AS n, count(*) FILTER (NOT bad) AS n_valid FROM o WHERE NOT (bad AND back = 1) GROUP BY 1""",
    "tsv_round_trip": "SELECT n_nationkey::INT AS n_nationkey, trim(replace(n_name, 'A', ' ')) AS n_name FROM nation",
    "csv_round_trip": "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::INT AS s_nationkey FROM supplier",
    "routed_round_trip": "SELECT CASE WHEN n_chars < 200 THEN 'excluded' WHEN lang = 'en' THEN 'accepted' ELSE 'keep' END AS route, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "manifest_counts": "SELECT count(*) AS rows, count(DISTINCT lang) AS languages, sum(n_chars)::BIGINT AS chars FROM documents",
    "markdown_report": """SELECT '| event_type | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY event_type) AS report FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
    "markdown_tables": "SELECT r_regionkey, r_name AS heading, n_nationkey::VARCHAR AS key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "fenced_contents": """SELECT n_nationkey, b::INT AS block, CASE b WHEN 0 THEN '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' ELSE n_name END AS content FROM nation, (VALUES (0), (1)) t(b)""",
    "env_settings": "SELECT n_nationkey AS file, 'KEY' AS key, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'NUMBER', n_regionkey::VARCHAR FROM nation",
    "settings_documents": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN n_name END AS k FROM nation",
    "variable_reads": "SELECT doc_id, array_to_string(list_filter(['a_1', lang, source], lambda x: regexp_full_match(x, '[A-Za-z_]\\w*')), ',') AS names FROM documents",
    "folded_names": "SELECT p_partkey, upper(replace(p_name, ' ', '_')) AS name FROM part",
    "asset_catalogs": """SELECT l_orderkey, 'a' || k AS id, arg_max(type, place) AS type, 'f/' || arg_max(s, place) || '.png' AS path FROM (
        SELECT l_orderkey, l_partkey % 5 AS k, l_suppkey AS s, CASE WHEN l_returnflag = 'A' THEN 'image' ELSE 'audio' END AS type, (l_returnflag = 'N')::BIGINT * 1000000000 + l_linenumber * 1000000 + l_suppkey AS place FROM lineitem WHERE l_returnflag IN ('A', 'N')) GROUP BY 1, 2""",
    "variable_kinds": """SELECT 'v' || user_id AS name, arg_max(CASE WHEN event_type IN ('error', 'purchase') THEN 'number' WHEN event_type = 'click' THEN 'boolean' ELSE 'string' END, event_id) AS kind,
        CASE WHEN count(DISTINCT event_type = 'signup') > 1 THEN 'mixed' WHEN bool_or(event_type = 'signup') THEN 'global' ELSE 'temp' END AS mode FROM events GROUP BY 1""",
    "script_parents": """WITH p AS (SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2), q AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linestatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM p)
        SELECT l_orderkey, 'IF' AS head, 0 AS depth, count(*) AS n, -count(*)::BIGINT AS parents FROM q GROUP BY 1 UNION ALL SELECT l_orderkey, 'SHOW', 1, sum(n)::BIGINT, sum(n * line)::BIGINT FROM q GROUP BY 1""",
    "json_sizes": "SELECT doc_id, (2 * (2 + 2 + 4 + 1 + length(lang)) + 24)::BIGINT AS bytes FROM documents",
    "path_edits": """SELECT n_nationkey, '{"a":{"k":' || n_nationkey || '},"b":{"c":1}}' AS json, '{"b":{"c":1}}' AS without FROM nation""",
}
