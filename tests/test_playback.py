"""Assertions, motions, loops, best matches and plain requests on small tables, with odd rows."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from strataforge.operators import dryrun, motion, natural, space

WANTED = "run long, assertion string, type string, name string, value string, count long, exact boolean, x double, y double, tolerance double, property string"
VARIABLES = "run long, name string, before string, after string"
ELEMENTS = "run long, element string, x double, y double, properties map<string,string>"
LOG = "run long, kind string, id string, success boolean, late boolean"


def _want(*rows):
    names = [x.split()[0] for x in WANTED.split(", ")]
    return [tuple({"run": 1, **r}.get(n) for n in names) for r in rows]


def test_assertions_on_odd_facts(spark):
    wanted = spark.createDataFrame(
        _want(
            {"assertion": "null type", "type": None},
            {"assertion": "null is not absent", "type": "variable_equals", "name": "n"},
            {"assertion": "null equals null", "type": "variable_equals", "name": "n", "value": "null"},
            {"assertion": "1 is not 1.0", "type": "variable_equals", "name": "one", "value": "1.0"},
            {"assertion": "null is false", "type": "variable_truthy", "name": "n"},
            {"assertion": "empty list is true", "type": "VARIABLE_TRUTHY", "name": "list"},
            {"assertion": "any absent", "type": "any_variable_equals"},
            {"assertion": "unset became set", "type": "variable_changed_after_actions", "value": "1"},
            {"assertion": "stayed", "type": "variable_changed_after_actions", "value": "[]"},
            {"assertion": "edge of tolerance", "type": "element_position", "name": "e", "x": 11.0, "y": 5.0},
            {"assertion": "beyond", "type": "element_position", "name": "e", "x": 11.0, "y": 5.0, "tolerance": 0.5},
            {"assertion": "no place", "type": "element_position", "name": "bare", "x": 0.0, "y": 0.0},
            {"assertion": "no property", "type": "element_property_equals", "name": "bare", "property": "p", "value": "1"},
            {"assertion": "never", "type": "event_emitted", "name": "quiet", "count": 0, "exact": True},
            {"assertion": "failed commands do not count", "type": "command_executed", "name": "c", "count": 1, "exact": True},
            {"assertion": "late", "type": "event_execution_after_actions", "count": 1, "exact": True},
            {"assertion": "other run", "type": "element_exists", "name": "e", "run": 2},
        ),
        WANTED,
    )
    variables = spark.createDataFrame([(1, "n", "null", "null"), (1, "one", None, "1"), (1, "list", "[]", "[]"), (1, "unset", None, None)], VARIABLES)
    elements = spark.createDataFrame([(1, "e", 10.0, 5.0, {"p": "1"}), (1, "bare", None, None, None)], ELEMENTS)
    log = spark.createDataFrame([(1, "command", "c", True, False), (1, "command", "c", False, False), (1, "command", "c", None, True), (1, "execution", "x", True, True), (1, "execution", "x", True, None)], LOG)
    got = {r.assertion: r.passed for r in dryrun.checked(wanted, variables, elements, log).collect()}
    fine = {"null equals null", "empty list is true", "unset became set", "edge of tolerance", "never", "failed commands do not count", "late"}
    assert len(got) == 17
    assert {a for a, passed in got.items() if passed} == fine


def test_assertions_without_facts(spark):
    wanted = spark.createDataFrame(_want({"assertion": "a", "type": "truthy_variable_count", "count": 0}, {"assertion": "b", "type": "element_exists", "name": "e"}), WANTED)
    empty = [spark.createDataFrame([], s) for s in (VARIABLES, ELEMENTS, LOG)]
    results = dryrun.checked(wanted, *empty)
    assert sorted((r.assertion, r.actual, r.passed) for r in results.collect()) == [("a", "0", True), ("b", "false", False)]
    assert [tuple(r) for r in dryrun.run_verdicts(results).collect()] == [(1, False, ["b"])]
    assert dryrun.checked(wanted.where("false"), *empty).count() == 0


def _fold(rows):
    """``(x, scale, angle)`` after each command, one after the other."""
    x, scale, angle, out = 0, 1.0, 0, []
    for value, factor, degrees, relative, near in rows:
        if value is not None and value != -1:
            x = x + value if relative else value
        if relative:
            scale = (scale or 1.0) * (factor or 1.0)
        else:
            scale = (scale or 1.0) if factor is None else factor
        if degrees is not None:
            to = angle + degrees if relative else degrees
            if near:
                way = (to - angle) % 360
                to = angle + (way - 360 if way > 180 else way)
            angle = to
        out.append((x, scale, angle))
    return out


def test_motions_equal_a_fold(spark):
    rng = random.Random(5)
    streams = {}
    for key in (1, 2, 3, None):
        streams[key] = [
            (rng.choice([None, -1, 0, 7, 40]), rng.choice([None, 0.0, 0.5, 2.0, 3.0]), rng.choice([None, -720, -190, -180, 0, 10, 179, 180, 181, 1000]), rng.random() < 0.6, rng.random() < 0.5)
            for _ in range(80)
        ]
    rows = [(k, n, *r) for k, s in streams.items() for n, r in enumerate(s)]
    df = spark.createDataFrame(rows, "k long, n long, v long, f double, d long, relative boolean, near boolean")
    df = motion.moved(df, ["k"], ["n"], F.col("v"), F.col("relative"), to="x")
    df = motion.scaled(df, ["k"], ["n"], F.col("f"), F.col("relative"))
    df = motion.turned(df, ["k"], ["n"], F.col("d"), F.col("relative"), F.col("near"))
    got = {(r.k, r.n): (r.x, r.scale, r.angle) for r in df.collect()}
    for k, s in streams.items():
        for n, (x, scale, angle) in enumerate(_fold(s)):
            assert got[k, n][0] == x and got[k, n][2] == angle
            assert math.isclose(got[k, n][1], scale)


def test_moves_from_a_start_and_without_a_keeping_value(spark):
    df = spark.createDataFrame([(1, 5, True), (2, -1, True), (3, -1, False), (4, 2, None)], "n long, v long, relative boolean")
    got = motion.moved(df.withColumn("k", F.lit(1)), ["k"], ["n"], F.col("v"), F.col("relative"), start=F.lit(100), keep=None)
    assert [r["at"] for r in got.orderBy("n").collect()] == [105, 104, -1, 2]


def _executed(rows):
    """Commands ``(round, place, id, ok, go_on, breaks, next)`` that run, by rounds one after the other."""
    out = []
    for n in sorted({r[0] for r in rows}):
        body = sorted((r for r in rows if r[0] == n), key=lambda r: r[1])
        ended = False
        for r in body:
            out.append((n, r[2], False))
            ended |= r[3] and r[5]
            if not r[3] and not r[4]:
                break
            called = next((x for x in body if r[6] is not None and x[2] == r[6]), None)
            if called:
                out.append((n, called[2], True))
                ended |= called[3] and called[5]
        if ended:
            break
    return out


def test_rounds_equal_a_loop(spark):
    rng = random.Random(11)
    rows = []
    for k in range(40):
        for n in range(4):
            for place in range(5):
                ok = rng.random() < 0.8
                rows.append((k, n, place, rng.choice("abc"), ok, rng.random() < 0.5, rng.random() < 0.08, rng.choice("abz") if ok and rng.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "k long, n long, place long, id string, ok boolean, go_on boolean, breaks boolean, next string")
    got = sorted((r.k, r.n, r.id, r.extra) for r in motion.executed(df, ["k"], "n", "place", F.col("ok"), F.col("go_on"), F.col("breaks"), "id", "next").collect())
    assert got == sorted((k, *x) for k in range(40) for x in _executed([r[1:] for r in rows if r[0] == k]))


def test_counted_rounds(spark):
    df = spark.createDataFrame([("up", 0, 5, 2), ("down", 3, 0, -1), ("none", 3, 0, 1), ("stuck", 2, 1, 0), ("still", 1, 2, 0), ("null", None, 2, 1), ("long", 0, 10**9, 1)], "name string, a long, e long, s long")
    rows = motion.counted_rounds(df, F.col("a"), F.col("e"), F.col("s"))
    short = {(r.name, r.i) for r in rows.where("name in ('up', 'down', 'none', 'still', 'null')").collect()}
    assert short == {("up", 0), ("up", 2), ("up", 4), ("down", 3), ("down", 2), ("down", 1)}
    assert {r.name: r["count"] for r in rows.where("name in ('stuck', 'long')").groupBy("name").count().collect()} == {"stuck": 100_000, "long": 100_000}
    items = motion.item_rounds(spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k long, l array<string>"), F.col("l"))
    assert sorted((r.k, r["round"]) for r in items.collect()) == [(1, 0), (1, 1)]


def test_best_match(spark):
    box = "id long, x0 long, y0 long, x1 long, y1 long"
    left = spark.createDataFrame([(1, 0, 0, 10, 10, "card"), (2, 100, 100, 110, 110, None), (3, 500, 500, 501, 501, "card"), (4, -30, -30, -20, -20, "tile")], box + ", kind string")
    right = spark.createDataFrame([(7, 5, 5, 15, 15, ["card"]), (6, 5, 5, 15, 15, ["tile"]), (8, 10, 10, 30, 30, None), (9, 110, 110, 120, 120, []), (5, -25, -25, 5, 5, ["card"])], box + ", accepts array<string>")
    got = {r.left_id: (r.right_id, r.area, r.met, r.fits) for r in space.best_match(left, right, 8).collect()}
    # equal areas: the smaller id; touching corners meet without an area
    assert got == {1: (5, 25, 4, True), 2: (9, 0, 1, True), 4: (5, 25, 1, False)}
    assert space.best_match(left, right.where("false"), 8).count() == 0


def test_reworded(spark):
    texts = ["  show   X .", "show", "", None, "please", "keep!", "a?"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    said = natural.reworded(F.col("t"), [("^please", ""), ("X", "Y"), ("Y", "Z")], F.col("n"), "show", ["put", "let"], "nothing.")
    assert [r.s for r in df.select("n", said.alias("s")).orderBy("n").collect()] == ["put Z.", "let.", "nothing.", None, "nothing.", "keep.", "a."]


def test_templates(spark):
    df = spark.createDataFrame([(0, "f", "A"), (4, "f", None), (-1, "f", "{n}"), (1, "g", "A"), (1, None, "A")], "n int, family string, topic string")
    said = natural.templated({"f": ["{topic} {n}", "{n}", "{topic}!"]}, F.col("family"), F.col("n"), {"topic": F.col("topic"), "n": F.col("n")})
    assert [r.s for r in df.select(said.alias("s")).collect()] == ["A 0", "4", "-1!", None, None]
    bounds = natural.family_of(F.col("n"), [(0, "low"), (3, "mid")])
    assert [r.s for r in df.select(bounds.alias("s")).collect()] == ["low", None, "low", "mid", "mid"]


def test_outputs_stay(spark):
    kind = "k string, output string"
    before = spark.createDataFrame([("a", '{"x":1,"y":[2]}'), ("b", '{"x":1}'), ("c", '{"x":1}'), ("d", "no json"), ("e", "1"), ("g", None)], kind)
    after = spark.createDataFrame([("a", '{"y": [2], "x": 1}'), ("b", '{"x":2}'), ("c", '{"x":2}'), ("d", "no json"), ("f", "1"), ("g", None)], kind)
    got = {r.k: r.state for r in natural.unchanged(before, after, "k", "output", spark.createDataFrame([("c",), ("c",)], "k string")).collect()}
    assert got == {"a": "same", "b": "changed", "c": "repaired", "d": "same", "e": "lost", "f": "new", "g": "same"}


def test_natural_view(spark):
    records = spark.createDataFrame([("a", "{}", "Ask Rose 2 for Rose."), ("b", "{}", "x"), ("c", "{}", None), ("d", "{}", "lost")], "k string, output string, said string")
    reasons = spark.createDataFrame([("b", "late"), ("b", "early"), ("b", "early"), ("a", "unknown")], "k string, reason string")
    outputs = spark.createDataFrame([("a", "{ }"), ("b", "{}"), ("c", "[]")], "k string, output string")
    none = spark.createDataFrame([], "k string, intent string")
    view = natural.natural_view(records, "k", F.col("said"), reasons, ["early", "late"], outputs, none, none.unionByName(spark.createDataFrame([("c", "Fixed Rose")], "k string, intent string")), ["Rose 2", "Rose"], "it")
    got = {r.k: (r.reason, r.intent, r.error) for r in view.collect()}
    assert got == {"a": (None, "Ask it for it.", None), "b": ("early", None, None), "c": (None, "Fixed it", "output_changed"), "d": (None, "lost", "output_lost")}
    counts = {r.reason: (r.records, r.repaired, r.errors) for r in natural.view_counts(view, none, "k").collect()}
    assert counts == {None: (3, 0, 2), "early": (1, 0, 0)}


def test_plain_catalog(spark):
    texts = ['[{"id":"r","path":"a/G12-Rose/intro-Rose.png","title":"Rose"},null]', "[]", None, "no", '[{"type":"image","exists":false}]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = natural.plain_catalog(F.col("t"), [(r"(^|/)G\d+-[^/]+/", "$1"), (r"intro-[^/.]+\.", "intro.")])
    assert [r.p for r in df.select(plain.alias("p")).collect()] == ['[{"id":"r","path":"a/intro.png"}]', "[]", "[]", "[]", '[{"type":"image","path":"","exists":false}]']
