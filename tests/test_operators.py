from __future__ import annotations

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from strataforge.functions import scalars
from strataforge.operators import curate, events, ordered, report, rules, space, tree
from strataforge.plans import curation
from tests.oracle import difference


@pytest.mark.parametrize("modulus", [2, 5, 10, 15])
def test_hash_modulus(spark, modulus):
    rows = spark.range(60).select(F.col("id").cast("string").alias("k"))
    for r in rows.select("k", scalars.sha256_mod(F.col("k"), modulus).alias("m")).collect():
        assert r.m == int(hashlib.sha256(r.k.encode()).hexdigest(), 16) % modulus


def test_hash_modulus_without_rule():
    with pytest.raises(ValueError):
        scalars.sha256_mod(F.lit("x"), 7)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.folded_name(F.lit(" show - image ")).alias("name"), scalars.truthy(F.lit("False")).alias("off"), scalars.truthy(F.lit("no")).alias("on"),
        scalars.guarded_divide(F.lit(6.0), F.lit(0.0)).alias("kept"), scalars.clamp_score(F.lit(2.5)).alias("even"), scalars.without_fence(F.lit("```json\n{}\n```")).alias("inside"),
        scalars.variable_names(F.lit("{a} ${b} {c}")).alias("names"), scalars.preview(F.lit("a\n\n b \nc"), 2).alias("preview"), scalars.nearest_rank(F.array(*map(F.lit, range(100))), 0.95).alias("p95"),
    ).first()
    assert (row.name, row.off, row.on, row.kept, row.even, row.inside, row.names, row.preview, row.p95) == ("SHOW_IMAGE", False, True, 6.0, 2.0, "{}", ["a", "c"], "a / b", 94)


def test_nested_tree(spark):
    doc = {"commands": [{"type": "if_condition", "parameters": {"trueCommands": [{"type": "loop", "parameters": {"commands": [{"type": "wait"}]}}], "falseCommands": []}}, {"type": "show_choices", "parameters": {"options": [{"commands": [{"type": "emit_signal"}]}]}}, 5]}
    rows = {(r.stream_key, r.ordinal, r.type, r.depth) for r in tree.index_commands(spark.createDataFrame([(1, json.dumps(doc))], "id int, t string"), "id", "t").collect()}
    assert rows == {("main", 0, "IF_CONDITION", 0), ("main", 1, "SHOW_CHOICES", 0), ("main/0/trueCommands", 0, "LOOP", 1), ("main/1/options/0", 0, "EMIT_SIGNAL", 1), ("main/0/trueCommands/0/commands", 0, "WAIT", 2)}


def test_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "c": true}'), (2, "no json"), (3, None)], "id int, j string")
    assert {(r.id, r.path, r.value) for r in tree.leaves(df, "id", "j").collect()} == {(1, "$.a.b[0]", "1"), (1, "$.a.b[1]", "x"), (1, "$.c", "true")}


def test_script_lines(spark):
    text = "IF a eq 1\n    SAY hello\n    LOOP 3\n        WAIT 5\nELSE\n    WAIT 1\n"
    rows = [(r.line, r.depth, r.head, r.parent) for r in tree.script_lines(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("line").collect()]
    assert rows == [(0, 0, "IF", None), (1, 1, "SAY", 0), (2, 1, "LOOP", 0), (3, 2, "WAIT", 2), (4, 0, "ELSE", None), (5, 1, "WAIT", 4)]


def test_rules_report_all_errors(spark):
    df = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "id int, n int, s string")
    got = {r.id: r.errors for r in rules.check(df, {"n_small": F.col("n") < 3, "s_is_a": F.col("s") == "a"}).collect()}
    assert got == {1: ["n_small"], 2: ["n_small", "s_is_a"]}


def test_touching_rectangles(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "i int, a double, b double, c double, d double")
    b = spark.createDataFrame([(2, 1.0, 0.0, 2.0, 1.0), (3, 1.1, 0.0, 2.0, 1.0)], "i int, a double, b double, c double, d double")
    assert [tuple(r) for r in space.overlaps(a, b, 0.3).collect()] == [(1, 2, 0.0)]


def test_overlay_and_exclude(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    repairs = spark.createDataFrame([(1, "FIX", "A"), (2, "EXCLUDE", None)], "id int, action string, t string")
    assert {tuple(r) for r in curate.overlay(base, repairs, "id", ["t"], "action").collect()} == {(1, "A", True), (3, "c", False)}


def test_whole_items_of_any_length_and_script(spark, tmp_path):
    sentence = "One two, three four five six seven eight nine ten."
    items = [" ".join(sentence.split()[:n]) for n in range(1, 11)]
    items += ["Съешь ещё этих мягких булок", "νὺξ δ' ὀρφναίη τὸν ἔχει", "我能吞下玻璃而不伤身体", "いろはにほへとちりぬるを", "字", "นายสังฆภัณฑ์", "यह एक वाक्य है", "a b a b a b a b a b a b", "", "...", "x\ny z", "wo, three fo", "absent words of this", None]
    texts = [f"Before{t}after" for t in items if t is not None and not t.startswith("absent")] + [sentence.lower(), "", None, "我能吞下玻璃", "a b a b a b", "One two,  three four"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "One two, three"), (None, "x\ny z")]
    want = sorted(((d, i) for d, t in docs for i, x in enumerate(items) if t is not None and x is not None and x in t), key=str)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in curation.leak_check_exact(spark, str(tmp_path)).collect()), key=str)
    assert got == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert difference(curation.leak_check_exact(spark, str(tmp_path)), con, curation.SQL["leak_check_exact"]) == ""


def test_debounce_counts_from_last_accepted(spark):
    df = spark.sql("select 1 as k, id, timestamp_millis(id * 400) as ts from range(6)")
    assert sorted(r.id for r in events.debounce(df, "k", "ts", 700).collect()) == [0, 2, 4]


def test_as_of_takes_equal_time(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1)], "key string, t int")
    right = spark.createDataFrame([("k", 5, 50), ("k", 3, 30)], "key string, t int, v int")
    assert {(r.t, r.v) for r in ordered.as_of(left, right, "key", "t", "v").collect()} == {(5, 50), (1, None)}


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        report.weighted_score({"a": 0.5})
