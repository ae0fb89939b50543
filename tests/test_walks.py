"""One walk over a level against the operators on command tables."""

from __future__ import annotations

import itertools
import json

import pytest

from strataforge.operators import commands as c
from strataforge.operators import ledgers, segments

_ODD = ["", " ", None, 0, 1.5, True, "x", "variable", "expression", "eq", [], [1], {}, {"a": ""}]


@pytest.fixture(scope="module")
def odd_levels(spark):
    asked = [{"type": t, "key": k, "operator": o, "value": v} for t, k, o, v in itertools.product(["variable", "expression", None, 3], ["", "n"], ["eq", 5, None], ["", None, 0])]
    asked += [{"type": "variable", old: None} for old in ("variable", "left", "right")] + [{"type": "expression", "expression": x} for x in _ODD] + _ODD
    branches = [{"trueCommands": [], "falseCommands": []}, {"trueCommands": None}, {"trueCommands": [], "falseCommands": [], "then": None}]
    main = [{"id": i % 90, "type": "if-condition", "parameters": {"condition": a} | branches[i % 3]} for i, a in enumerate(asked)]
    main += [{"id": x, "type": "wait", "parameters": {"duration": y}} for x, y in itertools.product(_ODD, _ODD)]
    main += [{"id": "l", "type": " loop ", "parameters": {"commands": x}} for x in _ODD] + [{"type": x, "parameters": y} for x, y in itertools.product([None, "", 4, "se play", "SHOW-IMAGE"], [None, 5, {"soundId": "s"}])] + [3, None]
    events = [{"id": "e", "commands": [{"id": "l", "type": "BGM_PLAY"}, {"id": "only", "type": "BGM_PLAY", "parameters": {"musicId": "m"}}]}, {"commands": [{"id": "o2"}]}, 7]
    rows = [("a", json.dumps({"commands": main, "events": events})), ("b", json.dumps({"commands": [{"id": "l", "type": "WAIT", "parameters": {"duration": 1}}]})), ("c", "no"), ("d", None), ("e", "[]")]
    return spark.createDataFrame(rows, "level_key string, level_json string")


def test_errors_in_one_walk(odd_levels):
    rows = lambda df: sorted((r.command_key, r.level_key, r.type, tuple(r.errors)) for r in df.collect())
    got = rows(c.level_errors(odd_levels))
    assert got == rows(c.command_errors(c.level_commands(odd_levels))) and {r[1] for r in got} == {"a"}
    assert {"no_type", "no_id", "id_twice", "empty_loop", "old_branch_names", "condition_operator", "empty_expression"} <= {e for r in got for e in r[3]}


def test_modifiers_in_one_walk(odd_levels):
    modifiers = [{"type": "wait", "insert": ["A", "B"], "filter": {"duration": x}} for x in _ODD if x is not None] + [{"type": "IF_CONDITION", "insert": ["C"], "filter": {"parameters.condition.key": "n", "parameters.condition.value": 0}}, {"type": "bgm-play", "insert": ["D"]}]
    rows = lambda df: sorted(tuple(r) for r in df.select("level_key", "stream_key", "ordinal", "type", "inserted", "new_ordinal").collect())
    got = rows(c.level_modified(odd_levels, modifiers))
    assert got == rows(c.with_modifiers(c.level_commands(odd_levels), modifiers)) and {"A", "B", "C", "D"} <= {r[3] for r in got}


def test_fragments_read_a_level_once(odd_levels):
    found = segments.tree_fragments(odd_levels, "level_key", "level_json")
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate ") == 1
    assert [(r.level_key, r.suffix, r.fragment) for r in found.where("suffix like 'event%' or level_key = 'b'").orderBy("level_key", "suffix").collect()] == [
        ("a", "event1", '{"commands":[{"id":"l","type":"BGM_PLAY"},{"id":"only","parameters":{"musicId":"m"},"type":"BGM_PLAY"}],"id":"e"}'), ("a", "event1-cmd1", '{"id":"l","type":"BGM_PLAY"}'),
        ("a", "event1-cmd2", '{"id":"only","parameters":{"musicId":"m"},"type":"BGM_PLAY"}'), ("a", "event2", '{"commands":[{"id":"o2"}]}'), ("a", "event2-cmd1", '{"id":"o2"}'), ("a", "event3", "7"),
        ("b", "top1", '{"id":"l","parameters":{"duration":1},"type":"WAIT"}'),
    ]


def test_examples_read_a_level_once(spark):
    emit = lambda s: {"type": "emit_signal", "parameters": {"signal": s}}
    hears = lambda *s: [{"type": "custom", "target": x} for x in s]
    level = {"commands": [{"type": "LOOP", "parameters": {"commands": [emit("q")]}}, emit(5), 3], "events": [7, {"id": 4, "triggers": hears("z", " ", None)}, {"triggers": [*hears("q", "q"), 1, {"type": "auto"}]}, {"id": "e", "triggers": "q"}]}
    rows = spark.createDataFrame([(1, json.dumps(level)), (2, "no"), (3, None)], "k int, t string")
    written = []
    found = ledgers.coordination_examples(rows, "k", "t", lambda df: written.append(df.cache()) or written[-1])
    assert len(written) == 1
    assert sorted((r.number, r.pattern[:3], r.producer, r.signal, r.consumer) for r in found.collect()) == [
        (1, "sig", "main", "q", "None"), (2, "ind", None, None, "4"), (3, "der", None, None, "4"), (4, "der", None, None, "None"), (5, "der", None, None, "4"),
    ]
