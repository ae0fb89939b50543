"""Data sets, values of commands, and text sources against plain versions and by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strataforge.functions import values
from strataforge.operators import datasets as ds
from strataforge.plans.scenes import _saved
from strataforge.sources import files


def test_reviewed_view(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "b", False), (4, "b", True), (5, "c", True), (6, "d", True), (7, "e", True), (8, None, None)], "id int, text string, ok boolean")
    decisions = spark.createDataFrame([(4, "EXCLUDE"), (5, "FIX"), (6, "FIX"), (7, "PASS")], "id int, decision string")
    repairs = spark.createDataFrame([(5, "C"), (7, "E")], "id int, text string")
    view = ds.reviewed_view(rows, decisions, repairs, "id", ["text"], F.col("ok"))
    assert {r.id: (r.reason, r.action, r.text) for r in view.collect()} == {
        1: (None, "KEEP", "a"), 2: ("duplicate", None, "a"), 3: ("not_verified", None, "b"), 4: ("review_exclude", None, "b"), 5: (None, "FIX", "C"),
        6: ("missing_repair", None, "d"), 7: ("unasked_repair", None, "e"), 8: ("not_verified", None, None),
    }


def test_reports():
    good = {"system_prompt_sha256": "h", "source_groups": 3, "schema_version": "any"}
    quality, tokens = {"static_valid": True, "runtime_valid": True, "converted_rows": 3}, {"enable_thinking": False, "over_limit": [], "rows": 3}
    assert ds.report_errors(good, quality, tokens, "h") == []
    assert ds.report_errors(good | {"source_groups": 4}, quality | {"runtime_valid": None}, None, "x") == ["stale prompt", "gates not passed", "quality report over other rows", "no tokenizer report"]
    assert ds.report_errors(good, None, tokens | {"over_limit": [1]}, "h") == ["no quality report", "rows over the limit"]


@pytest.mark.parametrize("seed", range(3))
def test_two_keys_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "", *"abcdefghij"]), rng.choice([None, "", *range(12)])) for i in range(60)]
    rows = [(i, a, None if b is None else str(b)) for i, a, b in rows]
    seen_a, seen_b, want = set(), set(), {}
    for i, a, b in rows:
        want[i] = not (a and a in seen_a or b and b in seen_b)
        if want[i]:
            seen_a |= {a} if a else set()
            seen_b |= {b} if b else set()
    df = spark.createDataFrame(rows, "id int, plan string, print string")
    assert {r.id: r.accepted for r in ds.first_by_two_keys(df, "id", "plan", "print", _saved).collect()} == want
    assert ds.first_by_two_keys(df.limit(0), "id", "plan", "print", _saved).count() == 0


def test_operations_against_a_walk(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(30):
        x = None
        for i in range(rng.randint(1, 9)):
            op, v = rng.choice(["set", "add", "sub", "mul", "div"]), rng.choice([0.0, 0.5, 2.0, 4.0, None])
            rows.append((k, i, op, v))
            v = v or 0.0
            x = (1.0 if op in ("mul", "div") else 0.0) if x is None else x
            x = v if op == "set" else x + v if op == "add" else x - v if op == "sub" else x * v if op == "mul" else x if v == 0 else x / v
        want[k] = x
    got = ds.fold_operations(spark.createDataFrame(rows, "k int, i int, op string, v double"), "k", "i", "op", "v").collect()
    assert {r.k: r.value for r in got} == want


def test_loops(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (3, -1), (4, None)], "id int, n int")
    assert sorted((r.id, r.round) for r in ds.repeated(df, F.col("n")).collect()) == [(1, 0), (1, 1), (1, 2)]
    with pytest.raises(Exception, match="more than 2 rounds"):
        ds.repeated(df, F.col("n"), 2).collect()


def test_arithmetic():
    cases = {"1 + 2 * 3": "7", "(1+2)*3": "9", "-(2 - 5) / 2": "1.5", "7/2": "3.5", "1/0": "1/0", "2 +": "2 +", "abc": "abc", "": "", "1.5.2": "1.5.2", "2 ** 3": "2 ** 3", "--3": "3", "((4))": "4", "4)": "4)", "__import__('os')": "__import__('os')"}
    assert {t: values.evaluated(t) for t in cases} == cases
    assert values.evaluated(None) is None


def test_values(spark):
    rows = [("{ n }", "7"), ("{m}", None), ("a{n}", '"a{n}"'), ('say "x"\\', '"say \\"x\\"\\\\"'), ("", '""')]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("v", F.create_map(F.lit("n"), F.lit("7")))
    for r in df.withColumn("got", values.resolved(F.col("t"), F.col("v"))).collect():
        assert r.got == r.want, r
    df = spark.createDataFrame([("${a}+${ gameState.b }*${c}",), ("none",)], "t string").withColumn("v", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))
    assert [r[0] for r in df.select(values.substituted(F.col("t"), ["a", "b"], F.col("v"))).collect()] == ["1+2*0", "none"]
    df = spark.createDataFrame([("'a,b', 1 ,{n},true,NULL,x",), ("",)], "t string").withColumn("v", F.create_map(F.lit("n"), F.lit('"s"')))
    assert [r[0] for r in df.select(values.payload(F.col("t"), F.col("v"))).collect()] == [['"\'a"', '"b\'"', "1", '"s"', "true", "null", '"x"'], []]
    df = spark.createDataFrame([("the long name of long, level 3",)], "t string").withColumn("a", F.array(F.lit("long"), F.lit("long name"), F.lit(None), F.lit("")))
    assert df.select(values.normalized_intent(F.col("t"), F.col("a"), "X", [r"level \d+"])).first()[0] == "the X of X, X"


def test_paths(spark):
    from strataforge.operators import tree

    df = spark.createDataFrame([("x", '{"a":{"b":1},"c":{"d":{"e":2}}}'), ("y", '{"c":3}'), ("z", "[]")], "k string, j string")
    got = lambda p, v: {r.k: r.json for r in tree.with_path(df, "k", "j", p, v).collect()}
    assert got("c.d.f", 5) == {"x": '{"a":{"b":1},"c":{"d":{"e":2,"f":5}}}', "y": '{"c":{"d":{"f":5}}}'}
    assert got("c.d.e", None) == {"x": '{"a":{"b":1}}', "y": '{"c":3}'}
    assert got("c", None) == {"x": '{"a":{"b":1}}', "y": "{}"}


def test_script_lines(spark):
    from strataforge.operators import tree

    text = "if x\n    show a\n\n    loop 3\n        wait  1\n            deep\nend\n        lost"
    rows = tree.script_lines(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").collect()
    assert [(r.line, r.depth, r.head, r.rest, r.parent) for r in rows] == [(0, 0, "IF", "x", None), (1, 1, "SHOW", "a", 0), (3, 1, "LOOP", "3", 0), (4, 2, "WAIT", "1", 3), (5, 3, "DEEP", "", 4), (6, 0, "END", "", None), (7, 2, "LOST", "", None)]


def test_text_sources(spark):
    df = spark.createDataFrame([("a", '{"x":1}\n{bad\n{"x":2}\n{"x"'), ("b", '{"x":1}\n'), ("c", "{")], "f string, t string")
    lines = files.numbered_lines(df, "f", "t")
    kept = files.without_torn_tail(lines, "line")
    assert sorted((r.file, r.line, r.valid) for r in kept.select("file", "line", "valid").collect()) == [("a", 0, True), ("a", 1, False), ("a", 2, True), ("b", 0, True)]
    env = spark.createDataFrame([("e", "# A=1\nA = 'x y'\nexport B=\"q\"\r\nnothing\nA=2\nC=a=b")], "f string, t string")
    assert {(r.key, r.value) for r in files.env_rows(env, "f", "t").collect()} == {("A", "2"), ("B", "q"), ("C", "a=b")}
    got = files.settings_or_null(spark.createDataFrame([("a", '{"k":1}'), ("b", "{"), ("c", "[1]"), ("d", None)], "f string, t string"), "f", "t")
    assert {r.f: r.j for r in got.select(F.col("file").alias("f"), F.to_json("settings").alias("j")).collect()} == {"a": '{"k":1}', "b": None, "c": None, "d": None}
