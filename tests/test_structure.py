"""Canonical JSON, strict validity, skeletons, and labels of commands."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.functions import canonical
from strataforge.operators import coordination as co
from strataforge.operators import curate, tree
from strataforge.sources.shared import saved

TEXTS = [
    '{"b":1,"a":2}', '{"a":1.0}', '{"a":1.50}', '{"a":1e2}', '{"a":-0.0}', '{"a":-0}', '{"a":1E-7}', '{"a":12345678901234567890123}', '{"a":123456789012345678901234567890123456789012}', '"\\u00e9\\u0001\\/\\"\\n\\u2028<>"',
    '{"a":1,"a":2}', '{"a":1} junk', '{"a":1}{"b":2}', '{"a":1}] junk', "[1,2", '  {"a": [ ] } ', "", "  ", "null", '{"z":{"y":1,"x":[{"d":1,"c":2}]},"Z":0,"é":1,"𠮷":2,"￮":3}', "1.7976931348623157e308", "3.0e10", "1e16",
    "{'a':1}", '{"a":1,}', "01", '{"a":"\\ud83d\\ude00"}', "100.0", '{"a":tru}', "nul", "-1", '{"a,b":":, ","c":"\\\\",":":[1,{"x":","}]}', "+1", ".5", '\t"x"\n', '{"a":"x\ty"}', "1,2", "1],[2", ",1", "1 2", '"a" "b"', "[[],{}]", '{"a":{"b":{"c":[null,true,false]}}}',
]


def loads(text):
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def test_canonical_equals_dumps(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    got = df.select("t", canonical.is_json(F.col("t")).alias("fine"), canonical.canonical(F.col("t")).alias("c"), canonical.canonical(F.col("t"), True).alias("s"), canonical.canonical_hash(F.col("t"), True).alias("h")).collect()
    for r in got:
        if r.t is None:
            assert (r.fine, r.c, r.s, r.h) == (None,) * 4
            continue
        fine, value = loads(r.t)
        assert r.fine == fine, r.t
        assert r.c == (json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if fine else None), r.t
        spaced = json.dumps(value, sort_keys=True, ensure_ascii=False)
        assert r.s == (spaced if fine else None), r.t
        assert r.h == (hashlib.sha256(spaced.encode()).hexdigest() if fine else None)


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), x, max_size=4), max_leaves=12)


@settings(max_examples=4, deadline=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(values=st.lists(VALUES, min_size=40, max_size=60), junk=st.text(max_size=3))
def test_canonical_of_any_value(spark, values, junk):
    junk = junk.encode("utf-8", "ignore").decode()
    texts = [json.dumps(v) for v in values] + [json.dumps(v) + junk for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", canonical.canonical(F.col("t")).alias("c"), canonical.canonical(F.col("t"), True).alias("s")).collect():
        fine, v = loads(r.t)
        assert r.c == (json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) if fine else None), r.t
        assert r.s == (json.dumps(v, sort_keys=True, ensure_ascii=False) if fine else None), r.t


def test_broken_lists_what_python_refuses(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    assert {r.i for r in tree.broken(df, "i", "t").collect()} == {i for i, t in enumerate(TEXTS) if not loads(t)[0]}


def test_skeleton(spark):
    a = {"commands": [{"type": "show", "parameters": {"b": 1, "a": [{"type": "x", "parameters": {"o": {"commands": [{"type": "y"}]}}}, 5]}}, 7, {"type": "z", "parameters": []}]}
    b = json.loads(json.dumps(a).replace('"b": 1', '"b": {"q": 2}'))
    c = json.loads(json.dumps(a).replace('"b": 1', '"c": 1'))
    assert tree.skeleton(a["commands"]) == "SHOW{a,b}[X{o}[Y{}]]>Z{}" == tree.skeleton(b["commands"]) != tree.skeleton(c["commands"])
    deep: dict = {"type": "end"}
    for _ in range(3000):
        deep = {"type": "loop", "parameters": {"commands": [deep]}}
    assert tree.skeleton([deep]).count("[") == 3000
    rows = spark.createDataFrame([(1, json.dumps(a)), (2, json.dumps(b)), (3, json.dumps(c)), (4, "no"), (5, None)], "k int, t string")
    found = tree.skeletons(rows, "k", "t").select("tree_key", curate.structural_fingerprint(F.lit("p"), F.lit(None).cast("string"), F.lit("a b\nc"), F.col("skeleton")).alias("f"))
    prints = {r.tree_key: r.f for r in found.collect()}
    assert prints[1] == prints[2] == hashlib.sha1(b"p||abc|SHOW{a,b}[X{o}[Y{}]]>Z{}").hexdigest() != prints[3] and prints[4] == prints[5]


def test_labels(spark):
    loop = {"id": "l", "type": "loop", "parameters": {"condition": {"type": "variable", "key": "n"}, "commands": [{"id": "b", "type": "BREAK"}, 3, {"id": "i", "type": "IF_CONDITION", "parameters": {"trueCommands": [{"id": "t", "type": "WAIT"}]}}]}}
    doc = {"commands": [{"id": "a", "type": "WAIT"}, loop, {"id": "z", "type": "WAIT"}], "extra_events": [{"commands": [{"id": "e", "type": "WAIT"}]}, 4]}
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, "[]"), (4, None)], "k int, t string")
    got = {r.id: (r.grp, r.stream, r.ordinal, r.depth, r.enter, r.leave, r.until, r.looped) for r in co.labelled(rows, "k", "t").collect()}
    assert got == {
        "a": (-1, "main", 0, 0, 1, 1, 6, False), "l": (-1, "main", 1, 0, 2, 5, 6, False), "b": (-1, "main/1/commands", 0, 1, 3, 3, 5, True), "i": (-1, "main/1/commands", 2, 1, 4, 5, 5, True),
        "t": (-1, "main/1/commands/2/trueCommands", 0, 2, 5, 5, 5, True), "z": (-1, "main", 2, 0, 6, 6, 6, False), "e": (0, "main", 0, 0, 7, 7, 7, False),
    }


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        co.coordination_errors(spark.createDataFrame([(1, "{}")], "k int, t string"), "k", "t", None, None, "other")


def test_copies_are_labelled_once(spark):
    """Rules on texts are asked once for each text; the catalog is each change's own."""
    loop = json.dumps({"commands": [{"id": "a", "type": "LOOP", "parameters": {}}, {"id": "b", "type": "SE_PLAY", "parameters": {"soundId": "s"}}], "extra_events": []})
    rows = spark.createDataFrame([*((n, loop, "click_event") for n in range(40)), (50, "no", "auto_event"), (51, None, "complex_coordination")], "k int, t string, category string")
    asked = []

    def check(texts, key, text):
        asked.append(sorted(r[text] for r in texts.collect()))
        return co.lifecycle_errors(co.labelled(texts, key, text), key)

    got = sorted((r.k, r.rule, r.subject) for r in co.by_text(rows, "k", "t", saved, check).collect())
    assert asked == [["no", loop]] and got == [(n, "empty_loop", "a") for n in range(40)]
    catalog = spark.createDataFrame([(n, "s", "audio" if n % 2 else "image", "existing", n != 4) for n in range(1, 40)], "k int, id string, type string, origin string, present boolean")
    found = {(r.k, r.rule, r.subject) for r in co.coordination_errors(rows, "k", "t", catalog, saved).collect() if "resource" in r.rule or "asset" in r.rule}
    assert found == {(0, "resource", "s"), (4, "asset_absent", "s"), *((n, "resource_kind", "s:soundId") for n in range(2, 40, 2))}
    lacks = sorted((r.k, r.rule) for r in co.causal_errors(rows, "k", "t", saved).collect())
    assert lacks == [*((n, "no_completion") for n in range(40)), (50, "no_preparation"), (51, "no_confirmation"), (51, "no_preparation")]
