"""Curation queries: duplicates, splits, samples, ledgers, leaks, chat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions import scalars
from strataforge.operators import curate, ordered


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def exact_dedup(spark, d):
    return curate.first_of_each(_read(spark, d, "documents"), F.sha2("text", 256), "doc_id")


def normalized_dedup(spark, d):
    return curate.first_of_each(_read(spark, d, "documents"), curate.squeezed_hash(F.col("text")), "doc_id")


def dispositions(spark, d):
    rows = curate.dispositions(_read(spark, d, "documents"), "doc_id", "text", 200)
    return rows.select("doc_id", "disposition")


def hash_order_split(spark, d):
    return curate.hash_order_split(_read(spark, d, "documents").select("doc_id"), "doc_id", 42, 0.1)


def sticky_split(spark, d):
    known = _read(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("train").alias("split"))
    return curate.sticky_split(_read(spark, d, "documents").select("doc_id"), "doc_id", known)


def split_leakage(spark, d):
    """Texts that both sides of the split hold."""
    docs = _read(spark, d, "documents")
    split = curate.sticky_split(docs.select("doc_id"), "doc_id", _read(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("train").alias("split")))
    sides = docs.join(split, "doc_id").groupBy(F.sha2("text", 256).alias("key")).agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "validation").alias("n_validation"))
    return sides.where("n_train > 0 and n_validation > 0")


def blind_position(spark, d):
    return _read(spark, d, "documents").select("doc_id", curate.blind_position(F.col("doc_id")).alias("position"), scalars.sha256_mod(F.col("doc_id").cast("string"), 15).cast("int").alias("slot"))


def quota_sample(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return curate.quota_sample(docs, "lang", [F.desc("n_chars"), F.col("doc_id")], 20, 120).select("doc_id", "lang", "reason")


def source_cap(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "source")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.withColumn("place", place).where("place <= 15")


def ledger_overlay(spark, d):
    repairs = _read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "EXCLUDE").otherwise("FIX").alias("action"), F.when(F.col("toxic") == 1, "flagged").alias("lang"))
    return curate.overlay(_read(spark, d, "documents").select("doc_id", "lang", "source"), repairs, "doc_id", ["lang"], "action")


def ledger_mismatch(spark, d):
    docs, labels = _read(spark, d, "documents").where("lang = 'en'").select("doc_id"), _read(spark, d, "labels").select("doc_id")
    return curate.key_mismatches(docs, labels, "doc_id")


def duplicate_keys(spark, d):
    return curate.duplicate_keys(_read(spark, d, "orders").select("o_custkey"), "o_custkey")


def resume_anti_join(spark, d):
    return curate.resume(_read(spark, d, "documents").select("doc_id"), _read(spark, d, "labels").where("quality = 1"), ["doc_id"])


def both_sets(spark, d):
    orders = _read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    other = _read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("custkey"))
    return orders.intersect(other)


def only_one_set(spark, d):
    """Customers with an open order but none that is finished in the same year."""
    orders = _read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    return orders.where("o_orderstatus = 'O'").select("custkey", "year").subtract(orders.where("o_orderstatus = 'F'").select("custkey", "year"))


def types_first_seen(spark, d):
    return curate.first_seen(_read(spark, d, "events"), ["event_type"], "event_id")


def set_relations(spark, d):
    """Customers and years by whether they have open orders, finished ones, or both."""
    orders = _read(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    return curate.set_relations(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), ["custkey", "year"])


def benchmark_cases(spark, d):
    """Benchmark items as cases, with what they leave out."""
    items = _read(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.lit("hard")).alias("level"), F.when(F.col("item_id") % 2 == 0, F.lit(1280)).alias("width"))
    return items.select(F.format_string("case-%04d", "item_id").alias("id"), F.trim("text").alias("task"), F.coalesce("level", F.lit("medium")).alias("level"), F.coalesce("width", F.lit(1920)).alias("width"), F.lit("(none)").alias("assets"))


def search_substring(spark, d):
    docs = _read(spark, d, "documents")
    return docs.where("lang = 'en' and text ilike '%license%'").orderBy("doc_id").limit(30).select("doc_id", "source")


def leak_check_exact(spark, d):
    """Benchmark items whose whole text stands in a document, by way of a run of tokens that each item has."""
    return curate.whole_items(_read(spark, d, "documents"), _read(spark, d, "benchmark"), "doc_id", "item_id", "text")


def leak_check_ngram(spark, d):
    docs, items = _read(spark, d, "documents"), _read(spark, d, "benchmark")
    return curate.shared_word_grams(docs, items, "doc_id", "item_id", "text", 8)


def chat_rows(spark, d):
    """Conversations as one array of messages each; a conversation is one record, so its turns meet."""
    rows = _read(spark, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(turns, lambda m: F.concat_ws(": ", m["role"], m["text"])), "\n").alias("chat"))


def query_variants(spark, d):
    """Each benchmark item as one, two or three query forms."""
    items = _read(spark, d, "benchmark")
    rows = items.select("item_id", "text", F.explode(F.sequence(F.lit(1), (F.col("item_id") % 3 + 1).cast("int"))).alias("variant"))
    form = F.when(F.col("variant") == 1, F.col("text")).when(F.col("variant") == 2, F.concat(F.lit("TASK\n"), "text")).otherwise(F.concat(F.lit("TASK\n"), "text", F.lit("\nASSETS\n(none)")))
    return rows.select("item_id", "variant", form.alias("query"))


def context_frame(spark, d):
    rows = ordered.context_frame(_read(spark, d, "conversations"), ["conv_id"], "turn", F.col("role"), 2, 1)
    return rows.select("conv_id", "turn", F.array_join("context", ",").alias("context"))


def resource_subset(spark, d):
    """Parts that some order line uses, in the sizes asked for."""
    parts = _read(spark, d, "part").where("p_size between 10 and 20")
    return parts.join(_read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name", "p_size")


def lattice(spark, d):
    """A slot for each part, by strides that share no factor with the lists they step through; 28 in 100 slots have a motif, evenly spread."""
    slots = _read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("slot"))
    key = F.concat_ws("|", (F.col("slot") * 7 % 15).cast("string"), (F.col("slot") * 11 % 27).cast("string"), (F.col("slot") * 13 % 8).cast("string"))
    return slots.select("slot", key.alias("lattice_key"), F.substring(F.sha1(key), 1, 16).alias("fingerprint"), (F.col("slot") * 28 % 100 < 28).alias("motif"), F.element_at(F.array(F.lit("build"), F.lit("change"), F.lit("fix")), (F.col("slot") % F.when(F.col("slot") % 2 == 0, 3).otherwise(2) + 1).cast("int")).alias("template"))


def slot_grid(spark, d):
    kinds = _read(spark, d, "part").select("p_brand").distinct()
    return kinds.crossJoin(spark.range(10).select(F.col("id").cast("int").alias("slot"))).select("p_brand", "slot", F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), F.col("slot") % 3 + 1).alias("difficulty"))


QUERIES = {f.__name__: f for f in (exact_dedup, normalized_dedup, dispositions, hash_order_split, sticky_split, split_leakage, blind_position, quota_sample, source_cap, ledger_overlay, ledger_mismatch, duplicate_keys, resume_anti_join, both_sets, only_one_set, types_first_seen, set_relations, benchmark_cases, search_substring, leak_check_exact, leak_check_ngram, chat_rows, query_variants, context_frame, resource_subset, lattice, slot_grid)}

_DIGITS = "list_sum(list_transform(string_split(sha256(doc_id::VARCHAR), ''), lambda c: instr('0123456789abcdef', c) - 1))"
_LAST = "(instr('0123456789abcdef', right(sha256(doc_id::VARCHAR), 1)) - 1)"
_STICKY = f"""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'train'
        WHEN ({_LAST} + 6 * ({_DIGITS} - {_LAST}))::BIGINT % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents"""
_GRAMS = """WITH g(kind, id, gram) AS (
        SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) FROM (
            SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents
            UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') FROM benchmark) WHERE len(w) >= 8)
        SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM g d JOIN g b USING (gram) WHERE d.kind = 'd' AND b.kind = 'b' GROUP BY 1, 2"""
SQL = {
    "exact_dedup": "SELECT sha256(text) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "normalized_dedup": r"SELECT sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "dispositions": """SELECT doc_id, CASE WHEN length(text) < 200 THEN 'skipped_short' WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'skipped_duplicate' ELSE 'accepted' END AS disposition FROM documents""",
    "hash_order_split": """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || doc_id::VARCHAR), doc_id) <= greatest(1, round_even(count(*) OVER () * 0.1, 0)) THEN 'validation' ELSE 'train' END AS split FROM documents""",
    "sticky_split": _STICKY,
    "split_leakage": f"SELECT sha256(text) AS key, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'validation') AS n_validation FROM documents JOIN ({_STICKY}) USING (doc_id) GROUP BY 1 HAVING n_train > 0 AND n_validation > 0",
    "blind_position": f"SELECT doc_id, CASE WHEN {_LAST} % 2 = 0 THEN 'A' ELSE 'B' END AS position, ({_DIGITS}::BIGINT % 15)::INT AS slot FROM documents",
    "quota_sample": """WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS p FROM documents),
        o AS (SELECT *, row_number() OVER (ORDER BY p > 20, n_chars DESC, doc_id) AS k FROM r)
        SELECT doc_id, lang, CASE WHEN p <= 20 THEN 'quota' ELSE 'backfill' END AS reason FROM o WHERE k <= 120 OR p <= 20""",
    "source_cap": "SELECT doc_id, source, place::INT AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 15",
    "ledger_overlay": """SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE lang END AS lang, source, quality IS NOT NULL AS repaired
        FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 0""",
    "ledger_mismatch": """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'extra' ELSE 'missing' END AS problem
        FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "duplicate_keys": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING n > 1 OR o_custkey IS NULL",
    "resume_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "both_sets": "SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "only_one_set": "SELECT o_custkey AS custkey, year(o_orderdate)::INT AS year FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, year(o_orderdate)::INT FROM orders WHERE o_orderstatus = 'F'",
    "types_first_seen": "SELECT event_type, (row_number() OVER (ORDER BY min(event_id), event_type))::INT AS place FROM events GROUP BY 1",
    "set_relations": """SELECT o_custkey AS custkey, year(o_orderdate)::INT AS year, CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'both' WHEN min(o_orderstatus) = 'O' THEN 'left' ELSE 'right' END AS side FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2""",
    "benchmark_cases": "SELECT printf('case-%04d', item_id) AS id, trim(text) AS task, CASE WHEN item_id % 3 = 0 THEN 'hard' ELSE 'medium' END AS level, (CASE WHEN item_id % 2 = 0 THEN 1280 ELSE 1920 END)::INT AS width, '(none)' AS assets FROM benchmark",
    "search_substring": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND text ILIKE '%license%' ORDER BY doc_id LIMIT 30",
    "leak_check_exact": "SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
    "leak_check_ngram": _GRAMS,
    "chat_rows": "SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS chat FROM conversations GROUP BY 1",
    "query_variants": """SELECT item_id, v::INT AS variant, CASE v WHEN 1 THEN text WHEN 2 THEN 'TASK' || chr(10) || text ELSE 'TASK' || chr(10) || text || chr(10) || 'ASSETS' || chr(10) || '(none)' END AS query
        FROM (SELECT item_id, text, unnest(range(1, item_id % 3 + 2)) AS v FROM benchmark)""",
    "context_frame": """SELECT conv_id, turn, (SELECT string_agg(b.role, ',' ORDER BY b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 1) AS context FROM conversations a""",
    "resource_subset": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey IN (SELECT l_partkey FROM lineitem)",
    "lattice": """SELECT slot, k AS lattice_key, left(sha1(k), 16) AS fingerprint, slot * 28 % 100 < 28 AS motif, ['build', 'change', 'fix'][slot % CASE WHEN slot % 2 = 0 THEN 3 ELSE 2 END + 1] AS template FROM (
        SELECT p_partkey::BIGINT AS slot, (p_partkey*7%15)::VARCHAR || '|' || (p_partkey*11%27)::VARCHAR || '|' || (p_partkey*13%8)::VARCHAR AS k FROM part)""",
    "slot_grid": "SELECT p_brand, i::INT AS slot, ['easy', 'medium', 'hard'][i % 3 + 1] AS difficulty FROM (SELECT DISTINCT p_brand FROM part), range(10) t(i)",
}
