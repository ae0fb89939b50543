"""Queries over level changes: each order is a change that is sound or has one fault, dealt by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators import coordination as co
from strataforge.sources.shared import saved

#: A sound change; ``{n}`` in a text reads a variable.
SOUND = (
    '{"commands":['
    '{"id":"a1","type":"SHOW_IMAGE","parameters":{"elementId":"e1","resourceId":"r1"}},'
    '{"id":"a2","type":"SET_VARIABLE","parameters":{"key":"ready","op":"set","value":false}},'
    '{"id":"a3","type":"SET_CLICKABLE","parameters":{"elementId":"e1","commands":[{"id":"a4","type":"EMIT_SIGNAL","parameters":{"signal":"go"}}]}},'
    '{"id":"a5","type":"LOOP","parameters":{"condition":{"type":"variable","key":"n"},"commands":[{"id":"a6","type":"SET_VARIABLE","parameters":{"key":"n","op":"add","value":1}}]}},'
    '{"id":"a7","type":"show_text","parameters":{"elementId":"t1","parentId":"e1","text":"Seen {n}"}},'
    '{"id":"a8","type":"MOVE_TO","parameters":{"elementId":"t1","x":1,"y":2}}'
    '],"extra_events":['
    '{"id":"v1","name":"prepare","triggers":[{"type":"auto","start":"immediate"}],"commands":[{"id":"b1","type":"EMIT_SIGNAL","parameters":{"signal":"made"}}]},'
    '{"id":"v2","name":"note","triggers":[{"type":"custom","target":"made"}],"commands":[{"id":"b2","type":"SET_VARIABLE","parameters":{"key":"ready","op":"set","value":true}}]},'
    '{"id":"v3","name":"confirm","triggers":[{"type":"custom","target":"go"}],"commands":[{"id":"b3","type":"IF_CONDITION","parameters":{"condition":{"type":"variable","key":"ready","operator":"eq","value":true},'
    '"trueCommands":[{"id":"b4","type":"SET_VARIABLE","parameters":{"key":"done","op":"set","value":true}}],'
    '"falseCommands":[{"id":"b5","type":"SET_VARIABLE","parameters":{"key":"done","op":"set","value":false}}]}},'
    '{"id":"b6","type":"SE_PLAY","parameters":{"soundId":"s1"}}]}]}'
)
A8 = '{"id":"a8","type":"MOVE_TO","parameters":{"elementId":"t1","x":1,"y":2}}'
AUTO = '{"type":"auto","start":"immediate"}'
CLICK, READY, COMPLEX = "click_event", "auto_event", "complex_coordination"
BRANCH = [(COMPLEX, "no_branch")]
#: What is replaced by what; the rules that this breaks as ``rule=subject``; what three categories then lack; and errors of order.
FAULTS: list[tuple[str, str, str, list, str]] = [
    ("", "", "", [], ""),
    (SOUND[len('{"commands":[') : SOUND.index('],"extra_events"')], "", "empty_commands= never_emitted=2:go", [(CLICK, "no_completion"), (COMPLEX, "no_confirmation")], ""),
    (SOUND[SOUND.index('{"id":"v1"') : -2], "", "empty_events= no_listener=go", [(CLICK, "no_completion"), (READY, "no_preparation"), (COMPLEX, "no_preparation"), (COMPLEX, "no_confirmation")], ""),
    ('"name":"prepare"', '"name":"prepare","when":1,"also":2', "event_fields=0:also,when", [], ""),
    ('"id":"v2"', '"id":" "', "event_id=1", [], ""),
    ('"id":"v2"', '"id":"v1"', "event_id_twice=v1", [], ""),
    ('"name":"note"', '"name":7', "event_name=1", [], ""),
    (f"[{AUTO}]", "[]", "event_triggers=0", [(READY, "no_preparation"), (COMPLEX, "no_preparation"), *BRANCH], ""),
    (AUTO, f"{AUTO},5", "trigger_no_object=0.1", [], ""),
    (AUTO, AUTO.replace("immediate", "later"), "trigger_start=0.0", [(READY, "no_preparation"), (COMPLEX, "no_preparation"), *BRANCH], ""),
    (AUTO, AUTO + ',{"type":"timer"}', "trigger_type=0.1", [], ""),
    ('"target":"made"', '"target":""', "trigger_target=1.0 no_listener=made", [(READY, "no_preparation"), (COMPLEX, "no_preparation"), *BRANCH], ""),
    ('"target":"go"', '"target":"stop"', "never_emitted=2:stop no_listener=go", [(CLICK, "no_completion"), (COMPLEX, "no_confirmation")], ""),
    ('"id":"a8"', '"id":""', "command_id=", [], ""),
    ('"id":"a8"', '"id":"b6"', "command_id_twice=b6", [], ""),
    ('"MOVE_TO"', '"SHOUT"', "command_type=SHOUT", [], ""),
    ('"type":"SE_PLAY","parameters":{"soundId":"s1"}', '"type":"SE_PLAY","parameters":[]', "parameters=b6", [], ""),
    ("Seen {n}", "Seen ${n}", "dollar=a7", [], ""),
    ('"resourceId":"r1"', '"resourceId":[]', "missing=a1:resourceId", [], ""),
    ('"condition":{"type":"variable","key":"ready"', '"condition":{"type":"clock","key":"ready"', "condition=b3", BRANCH, ""),
    ('"falseCommands":[{"id":"b5","type":"SET_VARIABLE","parameters":{"key":"done","op":"set","value":false}}]', '"falseCommands":null', "branch=b3:falseCommands", BRANCH, ""),
    ('"op":"add"', '"op":"keep"', "unbounded_loop=a5", [], ""),
    ('"condition":{"type":"variable","key":"n"},', "", "unbounded_loop=a5", [], ""),
    (A8, A8.replace("t1", "t2"), "element=a8:t2", [], "before_created=a8"),
    ('"parentId":"e1"', '"parentId":"e9"', "parent=a7:e9", [], ""),
    ("Seen {n}", "Seen {m} {m}", "variable=a7:m", [], ""),
    ('"soundId":"s1"', '"soundId":"s7"', "resource=s7", [], ""),
    ('"soundId":"s1"', '"soundId":"r1"', "resource_kind=r1:soundId", [], ""),
    ('"key":"ready","op":"set","value":true', '"key":"ready","op":"set","value":"true"', "", [(READY, "no_preparation"), (COMPLEX, "no_preparation"), *BRANCH], ""),
    ('"key":"done","op":"set","value":false', '"key":"undone","op":"set","value":false', "", BRANCH, ""),
    ('"signal":"made"', '"signal":"lost"', "never_emitted=1:made no_listener=lost", [(READY, "no_preparation"), (COMPLEX, "no_preparation"), *BRANCH], ""),
    # the element is made in a branch beside, in the loop before, or by the command around
    (A8, '{"id":"a9","type":"IF_CONDITION","parameters":{"condition":{"type":"expression","expression":"1"},"trueCommands":[{"id":"c1","type":"SHOW_TEXT","parameters":{"elementId":"t3","text":"x"}}],"falseCommands":[{"id":"c2","type":"UPDATE_TEXT","parameters":{"elementId":"t3","text":"y"}},{"id":"c3","type":"UPDATE_TEXT","parameters":{"elementId":"t1","text":"y"}}]}},{"id":"c4","type":"MOVE_TO","parameters":{"elementId":"t3","x":1,"y":1}}', "", [], "before_created=c2 before_created=c4"),
    (A8, '{"id":"a9","type":"SHOW_CHOICES","parameters":{"elementId":"q1","options":[{"commands":[{"id":"c1","type":"MOVE_TO","parameters":{"elementId":"q1","x":1,"y":1}},{"id":"c2","type":"BREAK","parameters":{}}]}]}}', "", [], "before_created=c1 break_outside_loop=c2"),
    ('"commands":[{"id":"a6","type":"SET_VARIABLE","parameters":{"key":"n","op":"add","value":1}}]', '"commands":[{"id":"a6","type":"SET_VARIABLE","parameters":{"key":"n","op":"add","value":1}},{"id":"c1","type":"BREAK","parameters":{}},{"id":"c2","type":"LOOP","parameters":{"condition":{"type":"expression","expression":"1"},"commands":[]}}]', "unbounded_loop=c2", [], "empty_loop=c2"),
]


def _changes(spark, d) -> DataFrame:
    """Orders as changes: the fault by the order's key, the category by the customer's."""
    pick = (F.col("o_orderkey") % len(FAULTS)).alias("fault")
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", pick, (F.col("o_custkey") % 3).alias("c"))
    doc = F.lit(SOUND)
    for n, (old, new, *_) in enumerate(FAULTS):
        if old:
            doc = F.when(F.col("fault") == n, F.lit(SOUND.replace(old, new, 1))).otherwise(doc)
    category = F.when(F.col("c") == 0, CLICK).when(F.col("c") == 1, READY).otherwise(COMPLEX)
    return rows.select("o_orderkey", category.alias("category"), doc.alias("doc"))


def _catalog(changes: DataFrame) -> DataFrame:
    """Two resources for every change; of each seventh one the sound is said to exist, but does not."""
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(k).alias("type")) for i, k in (("r1", "image"), ("s1", "audio"))))).alias("a")
    rows = changes.select("o_orderkey", kinds).select("o_orderkey", "a.*")
    return rows.withColumn("origin", F.lit("existing")).withColumn("present", ~((F.col("o_orderkey") % 7 == 0) & (F.col("id") == "s1")))


def coordination_errors(spark, d):
    changes = _changes(spark, d)
    return co.coordination_errors(changes, "o_orderkey", "doc", _catalog(changes), saved).select("o_orderkey", "severity", "rule", "subject")


def coordination_warnings(spark, d):
    """The same changes as parts of a level: what the level may add is a warning."""
    changes = _changes(spark, d)
    found = co.coordination_errors(changes, "o_orderkey", "doc", _catalog(changes), saved, "level_context")
    return found.groupBy("o_orderkey").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))


def causal_errors(spark, d):
    return co.causal_errors(_changes(spark, d), "o_orderkey", "doc", saved)


def lifecycle_errors(spark, d):
    """Elements of the changes' own commands by order and scope."""
    check = lambda texts, i, t: co.lifecycle_errors(saved(co.labelled(texts, i, t).where("grp = -1")), i)
    return co.by_text(_changes(spark, d), "o_orderkey", "doc", saved, check).select("o_orderkey", "rule", "subject")


QUERIES = {f.__name__: f for f in (coordination_errors, coordination_warnings, causal_errors, lifecycle_errors)}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


def _split(rules: str) -> list[list[str]]:
    return [x.split("=", 1) for x in rules.split()]


_BROKEN = f"""WITH f(fault, rule, subject) AS (VALUES {_values([(n, *r) for n, f in enumerate(FAULTS) for r in _split(f[2])])}),
    e AS (SELECT o_orderkey, rule, subject FROM orders JOIN f ON o_orderkey % {len(FAULTS)} = fault
        UNION ALL SELECT o_orderkey, 'asset_absent', 's1' FROM orders WHERE o_orderkey % 7 = 0)
    """
_SOFT = ", ".join(f"'{r}'" for r in co.OUTSIDE)
SQL = {
    "coordination_errors": _BROKEN + "SELECT o_orderkey, 'error' AS severity, rule, subject FROM e",
    "coordination_warnings": _BROKEN + f"SELECT o_orderkey, count(*) FILTER (rule NOT IN ({_SOFT})) AS n_errors, count(*) FILTER (rule IN ({_SOFT})) AS n_warnings FROM e WHERE rule NOT IN ('empty_commands', 'empty_events') GROUP BY 1",
    "causal_errors": f"""WITH f(fault, category, rule) AS (VALUES {_values([(n, *r) for n, f in enumerate(FAULTS) for r in f[3]])}),
        o AS (SELECT o_orderkey, o_orderkey % {len(FAULTS)} AS fault, CASE o_custkey % 3 WHEN 0 THEN '{CLICK}' WHEN 1 THEN '{READY}' ELSE '{COMPLEX}' END AS category FROM orders)
        SELECT o_orderkey, category, rule FROM o JOIN f USING (fault, category)""",
    "lifecycle_errors": f"""SELECT o_orderkey, rule, subject FROM orders JOIN (VALUES {_values([(n, *r) for n, f in enumerate(FAULTS) for r in _split(f[4])])}) f(fault, rule, subject) ON o_orderkey % {len(FAULTS)} = fault""",
}
