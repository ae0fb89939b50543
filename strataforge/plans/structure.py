"""Queries over canonical JSON, and over the structure of trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions.canonical import canonical_hash
from strataforge.operators import curate, tree
from strataforge.plans import scenes


def canonical_dedup(spark, d):
    """Documents as records whose keys, spaces and escapes differ by id: equal records are one class, by either style of hash."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("-")).alias("l"), (F.col("n_chars") % 40).cast("string").alias("n"), F.col("doc_id") % 4)
    text = lambda *parts: F.concat(*(F.col(p) if p in ("l", "n") else F.lit(p) for p in parts))
    forms = [
        text('{"input": {"lang": "', "l", '", "tags": ["a,b", "c: d"]}, "output": [{"n": ', "n", ', "ok": true, "é": null}]}'),
        text('{"output":[{"é":null,"ok":true,"n":', "n", '}],"input":{"tags":["a,b","c: d"],"lang":"', "l", '"}}'),
        text('{"output" :[{"\\u00e9":null, "n":', "n", ',"ok":true}] ,\n"input":{"lang":"', "l", '","tags":["a,b","c: d"]}}'),
        text('{"input":{"lang":"x","lang":"', "l", '","tags":["a,b","c: d"]},"output":[{"ok":true,"é":null,"n":', "n", "}]}"),
    ]
    doc = F.element_at(F.array(*forms), (F.col("doc_id") % 4 + 1).cast("int"))
    hashed = rows.select("doc_id", canonical_hash(doc).alias("sha256"), canonical_hash(doc, spaced=True).alias("spaced_sha256"))
    return hashed.groupBy("sha256", "spaced_sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def structural_dedup(spark, d):
    """Orders as command trees: the first of each structure, whatever the values in it."""
    levels = scenes.levels(spark, d)
    found = tree.skeletons(levels, "level_key", "level_json").select("tree_key", curate.structural_fingerprint(F.lit("order"), F.lit("t1"), F.lit(" build \n it "), F.col("skeleton")).alias("fingerprint"))
    return curate.first_of_each(found, F.col("fingerprint"), "tree_key").select("tree_key", F.col("key").alias("fingerprint"), "copies")


QUERIES = {f.__name__: f for f in (canonical_dedup, structural_dedup)}
SQL = {
    "canonical_dedup": """WITH x AS (SELECT doc_id, '{"input":{"lang":"' || coalesce(lang, '-') || '","tags":["a,b","c: d"]},"output":[{"n":' || n_chars % 40 || ',"ok":true,"é":null}]}' AS t,
            '{"input": {"lang": "' || coalesce(lang, '-') || '", "tags": ["a,b", "c: d"]}, "output": [{"n": ' || n_chars % 40 || ', "ok": true, "é": null}]}' AS s FROM documents)
        SELECT sha256(t) AS sha256, sha256(s) AS spaced_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM x GROUP BY t, s""",
    "structural_dedup": scenes._LINES + """, part AS (SELECT level_key, k, CASE flag WHEN 'N' THEN 'IF_CONDITION{condition,falseCommands,trueCommands}' || CASE WHEN q % 11 = 0 THEN '' ELSE '[EMIT_SIGNAL{signal}]' END
            WHEN 'R' THEN 'LOOP{commands,condition}[' || CASE WHEN q > 25 THEN 'SET_VARIABLE{key,op,value}' WHEN q % 13 = 0 THEN 'WAIT{}' ELSE 'WAIT{duration}' END || ']'
            ELSE CASE WHEN q % 7 = 0 THEN 'EMIT_SIGNAL{signal}' ELSE 'SHOW-IMAGE{elementId,resourceId}' END END AS t FROM ln),
        x AS (SELECT level_key, sha1('order|t1|buildit|' || string_agg(t, '>' ORDER BY k)) AS fingerprint FROM part GROUP BY 1)
        SELECT min(level_key) AS tree_key, fingerprint, count(*) AS copies FROM x GROUP BY 2""",
}
