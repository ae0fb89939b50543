from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from strataforge.operators import commands as c
from strataforge.operators import tree

SCENE = {
    "levels": [
        {"id": "L1", "name": "one", "resources": ["b", "a"], "commands": [
            {"id": "1", "type": "show-image", "parameters": {"elementId": "box", "resourceId": "a"}},
            {"id": "2", "type": "IF_CONDITION", "parameters": {"condition": {"type": "variable", "key": "x", "operator": "eq", "value": 1}, "trueCommands": [{"id": "3", "type": "EMIT_SIGNAL", "parameters": {"signal": "go"}}], "falseCommands": []}},
            {"id": "4", "type": "LOOP", "parameters": {"condition": {"type": "variable", "key": "n"}, "commands": [{"id": "5", "type": "SET_VARIABLE", "parameters": {"key": "n", "op": "add", "value": 1}}]}},
            {"id": "6", "type": "LOOP", "parameters": {"condition": {"type": "variable", "key": "m"}, "commands": [{"id": "7", "type": "WAIT", "parameters": {"duration": 1}}]}},
            {"id": "m1", "type": "MOVE_TO", "parameters": {"elementId": "ghost", "x": 1, "y": 2}},
        ], "events": [{"id": "e1", "name": "first", "triggers": [{"type": "custom", "target": "go"}], "commands": [{"id": "8", "type": "BGM_PLAY", "parameters": {"musicId": "zz"}}, {"id": "e", "type": "EMIT_SIGNAL", "parameters": {"signal": "on"}}]},
                      {"id": "e2", "name": "second", "triggers": [{"type": "custom", "target": "on"}], "commands": [{"id": "p", "type": "PLAY", "parameters": {"mediaId": "v"}}]}]},
        {"id": "L2", "name": "two", "commands": [
            {"id": "9", "type": "EMIT_SIGNAL", "parameters": {"signal": "nobody"}},
            {"id": "9", "type": "IF_CONDITION", "parameters": {"condition": {"type": "variable", "left": "x", "operator": "eq", "right": 1}, "trueCommands": [], "falseCommands": []}},
            {"type": "IF_CONDITION", "parameters": {"condition": {"type": "expression", "expression": " "}, "then": []}},
            {"id": "w", "type": "WAIT", "parameters": {}},
        ]},
    ]
}


@pytest.fixture(scope="module")
def levels(spark):
    return c.scene_levels(spark.createDataFrame([("s.json", json.dumps(SCENE)), ("bad.json", "{")], "path string, doc string"), "path", "doc").cache()


@pytest.fixture(scope="module")
def table(levels):
    return c.level_commands(levels).cache()


def test_levels_and_commands(levels, table):
    assert {(r.level_key, r.level_name, tuple(r.resources)) for r in levels.collect()} == {("s.json::0::L1", "one", ("a", "b")), ("s.json::1::L2", "two", ())}
    got = {(r.command_key, r.type, r.context) for r in table.collect()}
    assert ("s.json::0::L1::main::0", "SHOW_IMAGE", "main") in got
    assert ("s.json::0::L1::main/1/trueCommands::0", "EMIT_SIGNAL", "nested") in got
    assert ("s.json::0::L1::event/e1::0", "BGM_PLAY", "event") in got
    assert len(got) == 15


def test_references(spark, table):
    catalog = spark.createDataFrame([("a", "audio"), ("v", "video")], "id string, type string")
    refs = c.resource_references(table)
    assert {(r.resource_id, r.wanted) for r in refs.collect()} == {("a", "image"), ("zz", "audio"), ("v", "media")}
    assert {(r.resource_id, r.problem) for r in c.reference_problems(refs, catalog).collect()} == {("a", "wrong_kind"), ("zz", "unresolved")}
    assert {(r.level_key, r.resource_id, r.kind, r.placeholder) for r in c.level_resources(refs, catalog).collect()} == {("s.json::0::L1", "a", "audio", False), ("s.json::0::L1", "zz", "audio", True), ("s.json::0::L1", "v", "video", False)}


def test_signals_and_filters(levels, table):
    assert {(r.signal, r.event) for r in c.signal_graph(table, levels).collect()} == {("go", "e1"), ("on", "e2")}
    assert [(r.signal, r.problem, r.severity) for r in c.signal_problems(table, levels, "level_context").collect()] == [("nobody", "no_listener", "warning")]
    assert {(r.event, r.round) for r in c.reachable_events(table, levels, lambda df: df.cache()).collect()} == {("e1", 1), ("e2", 2)}
    assert {(r.level_key[-2:], r.reason) for r in c.idle_levels(table, levels).collect()} == {("L2", "signal_without_event"), ("L2", "empty_condition"), ("L1", "idle_loop")}


def test_idle_levels_in_one_walk(spark, levels, table):
    rows = lambda df: sorted((r.level_key, r.reason) for r in df.collect())
    assert rows(c.level_idle(levels)) == rows(c.idle_levels(table, levels))
    emit, wait = '{"type":"emit-signal","parameters":{"signal":"s"}}', '{"type":"wait"}'
    bodies = ["[]", f"[{wait}]", f'[{wait},{{"type":"Break"}}]', f"[{wait},5]", f'[{wait},{{"type":null}}]', f"[{emit}]", "null", f'[{{"type":["WAIT"]}}]']
    docs = [f'{{"commands":[{{"type":"loop","parameters":{{"commands":{b}}}}},{{"type":"LOOP","commands":{b}}}]}}' for b in bodies]
    docs += [f'{{"commands":[{{"type":"if condition","parameters":{{"trueCommands":{b},"falseCommands":{d}}}}}]}}' for b in bodies for d in bodies]
    docs += ['{"commands":[{"type":"IF_CONDITION","trueCommands":[1]},{"type":"IF_CONDITION","parameters":7}]}', "5", "[]", "{", "{}"]
    docs += [f'{{"commands":{x},"events":{e}}}' for x in (f"[{emit}]", f"[{wait}]") for e in ("[]", "{}", "null", "[1]", f'[{{"id":"main","commands":[{emit}]}}]')]
    odd = spark.createDataFrame([(f"k{n}", text) for n, text in enumerate([*docs, None])], "level_key string, level_json string")
    assert rows(c.level_idle(odd)) == rows(c.idle_levels(c.level_commands(odd), odd))


def test_contract(table):
    assert {(r.command_key.split("::", 2)[2], tuple(r.errors)) for r in c.command_errors(table).collect()} == {
        ("L2::main::0", ("id_twice",)), ("L2::main::1", ("id_twice", "condition_incomplete", "condition_old_names")),
        ("L2::main::2", ("no_id", "branches_not_lists", "old_branch_names", "empty_expression", "missing:trueCommands", "missing:falseCommands")), ("L2::main::3", ("missing:duration",)),
    }
    assert [r.key for r in c.unbounded_loops(table).collect()] == ["m"]
    assert [r.element for r in c.missing_elements(table).collect()] == ["ghost"]


def test_readable_and_modifiers(table):
    text = {r.level_key[-2:]: r.text for r in c.readable(table.where("event is null")).collect()}
    assert text["L2"] == "EMIT_SIGNAL\nIF_CONDITION\nIF_CONDITION\nWAIT"
    assert text["L1"].startswith("SHOW_IMAGE\nIF_CONDITION\n  EMIT_SIGNAL\nLOOP\n  SET_VARIABLE\n")
    mods = [{"type": "loop", "insert": ["LOG", "WAIT"]}, {"type": "LOOP", "insert": ["STOP"], "filter": {"parameters.condition.key": "m"}}, {"type": "move to", "insert": ["LOG"], "filter": {"x": 1, "y": "2"}}]
    rows = c.with_modifiers(table.where("level_key like '%L1' and stream_key = 'main'"), mods).orderBy("new_ordinal").collect()
    assert [r.type for r in rows] == ["SHOW_IMAGE", "IF_CONDITION", "LOG", "WAIT", "LOOP", "LOG", "WAIT", "STOP", "LOOP", "MOVE_TO"]


def test_conditions(spark):
    cases = [("5", "gt", "10", False), ("5", "lt", "10", True), ('"a"', "in", '["b", "a"]', True), ('"1"', "in", "[1]", False), ('"abc"', "contains", '"bc"', True), ("1", "eq", "1.0", True), ("1", "eq", '"1"', False), ("1", "ne", '"1"', True), ('"x"', "gt", "1", False), ("2", "gte", "2", True), ("true", "eq", "true", True), ('"b"', "gt", '"a"', True), ("1", "like", "1", None)]
    df = spark.createDataFrame(cases, "v string, op string, w string, want boolean")
    for r in df.withColumn("got", c.compare(F.col("v"), F.col("op"), F.col("w"))).collect():
        assert r.got == r.want, r
    old = ['{"parameters": {"condition": {"variable": "x", "right": 3}, "then": [1], "elseCommands": [2]}}', '{"parameters": {"condition": {"type": "variable", "key": "k", "left": "z", "value": 0}}, "thenCommands": [4]}', "no json"]
    got = [tuple(r.c) for r in spark.createDataFrame([(x,) for x in old], "j string").select(c.repaired_condition(F.col("j")).alias("c")).collect()]
    assert got == [("variable", "x", "eq", "3", "[1]", "[2]"), ("variable", "k", "eq", "0", "[4]", "[]"), ("variable", None, "eq", None, "[]", "[]")]


def test_trees_of_any_depth_and_broken_ones(spark):
    deep = {"id": "0", "type": "LOOP", "parameters": {"commands": []}}
    for i in range(1, 130):
        deep = {"id": str(i), "type": "loop", "parameters": {"commands": [deep, 7]}}
    rows = [("deep", json.dumps({"commands": [deep]})), ("broken", "{"), ("none", None), ("odd", '{"commands": 5}'), ("list", "[1]"), ("option", '{"commands": [{"type": 3, "parameters": {"options": [{"commands": [{"type": "a"}]}]}}, 1, null]}')]
    df = spark.createDataFrame(rows, "k string, t string")
    got = tree.index_commands(df, "k", "t").groupBy("tree_key").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()
    assert {(r.tree_key, r.n, r.d) for r in got} == {("deep", 130, 129), ("option", 2, 1)}
    assert [tuple(r) for r in tree.broken(df, "k", "t").collect()] == [("broken", "not JSON")]
    assert {r.stream_key for r in tree.index_commands(df.where("k = 'option'"), "k", "t").collect()} == {"main", "main/0/options/0"}
    assert tree.leaves(df.where("k = 'deep'"), "k", "t").count() == 130 * 2 + 129
    back = tree.rebuilt(tree.index_commands(df.where("k in ('deep', 'option')"), "k", "t")).collect()
    want = {"deep": json.loads(rows[0][1]), "option": json.loads(rows[5][1])}

    def objects(x):
        return {k: objects(v) for k, v in x.items()} if isinstance(x, dict) else [objects(v) for v in x if isinstance(v, dict)] if isinstance(x, list) else x

    assert {r.tree_key: json.loads(r.tree) for r in back} == {k: objects(v) for k, v in want.items()}


def test_rewritten_trees(spark):
    doc = {"commands": [{"id": "a", "type": "SE_PLAY"}, {"id": "i", "type": "IF_CONDITION", "parameters": {"trueCommands": [{"type": "SE_PLAY"}], "falseCommands": [{"type": "WAIT"}]}}, {"id": "j", "type": "IF_CONDITION", "parameters": {"trueCommands": [{"type": "SE_PLAY"}]}}], "events": [{"commands": [{"type": "SE_PLAY"}]}]}
    df = spark.createDataFrame([("x", json.dumps(doc)), ("y", "{")], "k string, t string")
    (row,) = tree.rewritten(df, "k", "t", tree.without_types({"SE_PLAY"})).collect()
    assert row.changes == 5
    assert json.loads(row.tree) == {"commands": [{"id": "i", "type": "IF_CONDITION", "parameters": {"trueCommands": [{"id": "i_noop", "type": "WAIT", "parameters": {"duration": 0}}], "falseCommands": [{"type": "WAIT"}]}}], "events": [{"commands": []}]}
    named = {"commands": [{"type": "SHOW_IMAGE", "parameters": {"resourceId": "a", "ui": {"skinId": "b"}, "commands": [{"type": "SE_PLAY", "parameters": {"soundId": "a"}}], "text": "a"}}]}
    (row,) = tree.rewritten(spark.createDataFrame([("x", json.dumps(named))], "k string, t string"), "k", "t", tree.with_new_ids(("resourceId", "skinId", "soundId"), {"a": "A", "b": "B"})).collect()
    assert row.changes == 3 and '"text":"a"' in row.tree and row.tree.count('"A"') == 2
    sizes = spark.createDataFrame([("x", '{"ab": [1, true, "cd", null]}'), ("y", None)], "k string, t string")
    assert {tuple(r) for r in tree.memory_estimates(sizes, "k", "t").collect()} == {("x", 4 + 8 + 1 + 4), ("y", 0)}


def test_variable_types(spark):
    rows = [("a", 1, "x", "set", "temp"), ("a", 2, "5", "set", "global"), ("b", 1, "true", "set", "temp"), ("c", 1, "q", "add", "temp")]
    got = {r.name: (r.kind, r.mode) for r in c.variable_types(spark.createDataFrame(rows, "name string, place int, value string, operation string, scope string")).collect()}
    assert got == {"a": ("number", "mixed"), "b": ("boolean", "temp"), "c": ("number", "temp")}


def test_events_without_names(spark):
    level = {"commands": [{"type": "a"}], "events": [{"commands": [{"type": "b", "commands": [{"type": "c"}]}]}, "no event", {"id": None, "name": "n", "commands": [{"type": "d"}]}, {"id": 7, "commands": [{"type": "e"}]}, {"id": "x"}]}
    rows = [("L", json.dumps(level)), (None, json.dumps(level)), ("empty", "{}"), ("broken", "{"), ("null", None), ("list", "[]"), ("odd", '{"commands": 1, "events": {}}')]
    got = c.level_commands(spark.createDataFrame(rows, "level_key string, level_json string")).collect()
    want = {("main", 0, "A", "main"), ("event/#0", 0, "B", "event"), ("event/#0/0/commands", 0, "C", "nested"), ("event/n", 0, "D", "event"), ("event/7", 0, "E", "event")}
    assert {(r.stream_key, r.ordinal, r.type, r.context) for r in got if r.level_key == "L"} == want
    assert len(got) == 10 and {r.level_key for r in got} == {"L", None}


def walks(df) -> int:
    """How often the plan walks documents."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_loops_in_one_walk(spark):
    """Loops and writes come from one walk; a write of the same variable counts only below its loop."""
    loop = lambda i, key, *inner: {"id": i, "type": "loop", "parameters": {"condition": {"type": "variable", "key": key}, "commands": list(inner)}}
    write = lambda key, op="add": {"type": "set-variable", "parameters": {"key": key, "op": op}}
    top = [loop("a", "x", loop("b", "y", write("x"))), write("y"), 5, loop("c", "x", write("x", "keep")), {"type": "LOOP"}, {"type": "LOOP", "parameters": {"condition": {"type": "expression", "expression": "1"}}}]
    levels = spark.createDataFrame([("k1", json.dumps({"commands": top})), ("k2", json.dumps({"commands": [loop("a", "x")]}))], "level_key string, level_json string")
    for found in (c.level_commands(levels), c.level_commands(levels, ("LOOP", "SET_VARIABLE"))):
        df = c.unbounded_loops(found)
        assert walks(df) == 1
        assert sorted((r.command_key, r.key) for r in df.collect()) == [("k1::main/0/commands::0", "y"), ("k1::main::3", "x"), ("k1::main::4", None), ("k2::main::0", "x")]
    plain = c.level_commands(levels, json=False).collect()
    assert {r.command_json for r in plain} == {None} and len(plain) == c.level_commands(levels).count() == 9


def test_pruned_levels_are_counted_in_one_walk(spark, sf_dir):
    """What is left after a change is counted where the change is made, without another walk or a join."""
    from strataforge.plans import scenes

    plan = scenes.scene_pruned(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    wait = {"type": "WAIT"}
    doc = {"commands": [{"type": "EMIT_SIGNAL"}, 7, {"type": "LOOP", "parameters": {"commands": [wait, wait]}}], "events": [{"commands": [wait, {"type": "EMIT_SIGNAL"}]}, 3]}
    rows = spark.createDataFrame([("a", json.dumps(doc)), ("b", '{"commands":[{"type":"EMIT_SIGNAL"}]}'), ("c", "no")], "k string, t string")
    got = tree.rewritten(rows, "k", "t", tree.without_types({"EMIT_SIGNAL"}), counted=True).collect()
    assert sorted((r.tree_key, r.tree, r.changes, r.left) for r in got) == [("a", None, 2, 4), ("b", None, 1, 0)]


def test_references_of_levels_are_found_in_one_walk(spark, sf_dir):
    """References need no command written and read again: with and without new names, as by way of the commands."""
    from strataforge.plans import scenes

    for query in (scenes.scene_references, scenes.scene_remapped):
        assert query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    commands = [
        {"id": "a", "type": "LOOP", "resourceId": 1.5, "parameters": {"soundId": None, "x.imageId": True, "style": {"list": [[{"animId": "n"}], "s"]}, "imageId": ["r1"], "commands": [{"type": "SE_PLAY", "parameters": {"soundId": "r1"}}]}},
        {"id": "b", "parameters": {"options": [{"skinId": "o", "commands": [{"parameters": {"mediaId": "r2"}}]}]}}, 5,
    ]
    texts = [json.dumps({"commands": commands, "events": [{"name": "e", "commands": commands}, 7]}), "[]", "{", None]
    rows = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "level_key string, level_json string")
    change = tree.with_new_ids(tuple(c.RESOURCE_FIELDS), {"r1": "new"})
    new = tree.rewritten(rows, "level_key", "level_json", change).selectExpr("tree_key AS level_key", "tree AS level_json")
    both = lambda df: sorted(df.collect(), key=repr)
    names = ("command_key", "path", "field", "resource_id", "wanted")
    for got, source in ((c.level_references(rows), rows), (c.level_references(rows, change), new)):
        want = both(c.resource_references(c.level_commands(source)).select(*names))
        assert len(want) == 12 and both(got.select(*names)) == want


def test_trees_are_rebuilt_as_a_stream(spark):
    """Trees are built from sorted rows, across batches, not one group after the other."""
    docs = [json.dumps({"commands": [{"id": n, "type": "LOOP", "parameters": {"commands": [{"id": f"{n}.{i}", "type": "X"} for i in range(n)]}}, {"id": "z", "type": "Y"}]}, separators=(",", ":")) for n in range(30)]
    rows = tree.index_commands(spark.createDataFrame([*((f"k{n}", t) for n, t in enumerate(docs)), (None, docs[3])], "k string, t string"), "k", "t")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = tree.rebuilt(rows)
        assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {r.tree_key: r.tree for r in found.collect()} == {**{f"k{n}": t for n, t in enumerate(docs)}, None: docs[3]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
