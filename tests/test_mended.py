"""Folds of any doubles, first objects of replies, and lines that are not quite JSON."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F

from strataforge.operators import assets
from strataforge.operators import commands as c
from strataforge.operators import datasets as ds
from strataforge.operators import ledgers, tree
from strataforge.sources import files, sinks
from strataforge.sources.shared import saved


def plain_fold(rows):
    x = 1.0 if rows[0][0] in ("mul", "div") else 0.0
    for op, v in rows:
        v = 0.0 if v is None else v
        x = {"set": lambda: v, "add": lambda: x + v, "sub": lambda: x - v, "mul": lambda: x * v, "div": lambda: x / v if v else x}.get(op, lambda: x)()
    return x


def test_fold_of_any_doubles(spark):
    r = random.Random(2)
    chains = {"tiny": [("mul", 0.5)] * 1200 + [("add", 3.0)], "zero": [("div", 0.0), ("mul", 4.0), ("div", 0.0)], "large": [("mul", 1e200), ("mul", 1e200), ("sub", 1.0)], "none": [("none", 1.0), ("add", None)], None: [("sub", 2.5)]}
    for n in range(30):
        chains[f"k{n}"] = [(r.choice(["set", "add", "sub", "mul", "div", "mul"]), r.choice([0.0, -0.0, 1e-300, 5e-324, 1e250, r.gauss(0, 1e5), 1 / 3])) for _ in range(r.randrange(1, 60))]
    rows = [(k, i, op, v) for k, chain in chains.items() for i, (op, v) in enumerate(chain)]
    r.shuffle(rows)
    got = {x.k: x.value for x in ds.fold_operations(spark.createDataFrame(rows, "k string, i int, op string, v double"), "k", "i", "op", "v").collect()}
    assert set(got) == set(chains) and got["tiny"] == 3.0
    for k, chain in chains.items():
        want = plain_fold(chain)
        assert got[k] == want or (math.isnan(got[k]) and math.isnan(want)), k
    assert ds.fold_operations(spark.createDataFrame([], "k string, i int, op string, v double"), "k", "i", "op", "v").count() == 0


def test_first_object(spark):
    texts = {
        'x {"a":1} y {"b":2} z': '{"a":1}', '```json\n{"b": {"c": "}"}, "a": [1]}\n``` {': '{"b": {"c": "}"}, "a": [1]}', '{"b":1, "a": "\\u007D"} }': '{"a":"}","b":1}', "{no} {\"a\":1}": None, '{"a":1': None, "[1]": None, "": None, None: None, '{"a":1}{"b":2}': '{"a":1}', '"{" {}': None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.j for r in df.select("t", assets.first_json(F.col("t")).alias("j")).collect()} == texts


def test_lines_with_more_than_one_value(spark):
    lines = ['{"a":1}', '{"a":1} junk', '{"a":1}{"b":2}', "", "3", "{"]
    text = spark.createDataFrame([("f", "\n".join(lines)), ("g", '{"a":1}\n{"a":2} x')], "file string, t string")
    rows = files.numbered_lines(text, "file", "t")
    assert {(r.file, r.line): r.valid for r in rows.collect()} == {("f", 0): True, ("f", 1): False, ("f", 2): False, ("f", 4): True, ("f", 5): False, ("g", 0): True, ("g", 1): False}
    assert {(r.file, r.line) for r in files.without_torn_tail(rows, "line").collect()} == {("f", i) for i in (0, 1, 2, 4)} | {("g", 0)}
    scene = '{"levels":[{"id":"L","commands":[{"id":"a","type":"WAIT"}]}]}'
    scenes = spark.createDataFrame([("s1", scene), ("s2", scene + " junk"), ("s3", scene + scene)], "path string, doc string")
    assert [r.scene_path for r in c.scene_levels(scenes, "path", "doc").collect()] == ["s1"]
    assert sorted(r.path for r in tree.broken(scenes, "path", "doc").collect()) == ["s2", "s3"]


def test_text_is_replaced_in_one_step(spark, tmp_path):
    path = f"{tmp_path}/notes/report.json"
    for text in ("one", "two é", ""):
        sinks.write_text(spark, path, text)
        assert (tmp_path / "notes" / "report.json").read_text() == text
    assert [p.name for p in (tmp_path / "notes").iterdir() if not p.name.startswith(".")] == ["report.json"]


def test_ledgers(spark):
    base = spark.createDataFrame([("a", 5, "x"), ("b", 9, "y"), ("b", 3, "z")], "k string, at int, v string")
    later = spark.createDataFrame([("b", 1, "w"), ("c", 7, None)], "k string, at int, v string")
    got = ledgers.merged_ledger(base, later, "k", "at").orderBy("rank_of", "first_place").collect()
    assert [tuple(r) for r in got] == [("b", 0, 3, "w"), ("a", 0, 5, "x"), ("c", 1, 7, None)]
    log = spark.createDataFrame([("a", 1, "pass"), ("a", 2, "clear"), ("b", 1, "clear"), ("b", 2, "fail")], "k string, at int, v string")
    assert [tuple(r) for r in ledgers.current_verdicts(log, "k", "at", "v").collect()] == [("b", "fail", 2)]


def test_examples_of_levels(spark):
    """Three consumers in the order of emission, each once; listeners fill up; the rest is derived in turn."""
    emit = lambda *s: [{"id": f"e{x}", "type": "EMIT_SIGNAL", "parameters": {"signal": x}} for x in s]
    event = lambda name, hears, *s: {"id": name, "triggers": [{"type": "custom", "target": h} for h in hears], "commands": emit(*s)}
    many = {"commands": [{"type": "IF_CONDITION", "parameters": {"trueCommands": emit("p")}}, *emit("q", "p")], "events": [event("v0", "q", "r"), event("v1", "pq"), event("v2", "r"), event("v3", "p"), event("v4", "z")]}
    few = {"commands": [], "events": [event("u0", "s", "t"), event("u1", "t"), event("u2", "", "s")]}
    rows = spark.createDataFrame([(1, json.dumps(many)), (2, json.dumps(few)), (3, json.dumps({"commands": emit("p"), "events": []})), (4, "no")], "k int, t string")
    got = sorted((r.k, r.number, r.pattern[:3], r.producer, r.signal, r.consumer) for r in ledgers.coordination_examples(rows, "k", "t", saved).collect())
    assert got == [
        (1, 1, "sig", "main", "p", "v1"), (1, 2, "sig", "main", "p", "v3"), (1, 3, "sig", "main", "q", "v0"), (1, 4, "der", None, None, "v0"), (1, 5, "der", None, None, "v1"), (1, 6, "der", None, None, "v2"),
        (2, 1, "sig", "event", "t", "u1"), (2, 2, "sig", "event", "s", "u0"), (2, 3, "der", None, None, "u0"), (2, 4, "der", None, None, "u1"), (2, 5, "der", None, None, "u0"),
    ]
