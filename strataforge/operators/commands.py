"""Analytics of command tables: scenes as relations, references, coordination, contracts, expansion."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.canonical import strict_variant
from strataforge.functions.scalars import folded_name
from strataforge.operators import tree

# Fields that name a resource, and the kind of resource each one takes.
RESOURCE_FIELDS = {
    "resourceId": "image", "imageId": "image", "soundId": "audio", "musicId": "audio", "animId": "animation",
    "skinId": "image", "frontResourceId": "image", "backResourceId": "image", "mediaId": "media",
}
MEDIA = ("image", "video", "audio", "media")
# Operators of conditions.
OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "in", "contains")
# Parameters that a command of a type must have.
REQUIRED = {
    "SET_VARIABLE": ("key", "value"), "WAIT": ("duration",), "MOVE_TO": ("elementId", "x", "y"), "SHOW_IMAGE": ("elementId", "resourceId"),
    "SHOW_TEXT": ("elementId", "text"), "UPDATE_TEXT": ("elementId", "text"), "SHOW_CHOICES": ("elementId", "options"), "SET_ELEMENT_STYLE": ("elementId", "style"),
    "IF_CONDITION": ("condition", "trueCommands", "falseCommands"), "JUMP_TO": ("target",), "LOOP": ("commands",), "EMIT_SIGNAL": ("signal",), "BGM_PLAY": ("musicId",),
    "SE_PLAY": ("soundId",), "SCENE_REDIRECT": ("url",),
}
#: Commands that make an element, and those that need one.  Fixed values.
CREATORS, DEPENDENTS = ("SHOW_IMAGE", "SHOW_TEXT"), ("MOVE_TO", "UPDATE_TEXT", "SET_ELEMENT_STYLE")


def scene_levels(scenes: DataFrame, path: str, json: str) -> DataFrame:
    """Levels of scene documents: ``level_key`` (path::index::id), name, its commands and events as JSON, and its resources."""
    rows = scenes.select(F.col(path).alias("scene_path"), F.posexplode(F.try_variant_get(strict_variant(F.col(json)), "$.levels", "array<variant>")).alias("level_index", "level"))
    text = lambda p: F.expr(f"try_variant_get(level, '{p}', 'string')")
    return rows.select(
        "scene_path", "level_index", F.concat_ws("::", "scene_path", F.col("level_index").cast("string"), text("$.id")).alias("level_key"), text("$.name").alias("level_name"),
        F.expr("to_json(level)").alias("level_json"), F.array_sort(F.coalesce(F.expr("try_variant_get(level, '$.resources', 'array<string>')"), F.array().cast("array<string>"))).alias("resources"),
    )


def _event_name(event: str) -> Column:
    return F.expr(f"coalesce(try_variant_get({event}, '$.id', 'string'), try_variant_get({event}, '$.name', 'string'))")


def level_commands(levels: DataFrame, types: tuple[str, ...] | None = None, json: bool = True) -> DataFrame:
    """All commands of levels, those of events in streams ``event/<id>`` (or name, or place); ``context`` is main, event or nested.

    A reader that asks for some ``types`` alone, or not for ``command_json``, can say so: the walk then leaves the others out.
    """
    both = tree.index_level_commands(levels, "level_key", "level_json", types, json)
    context = F.when(F.col("depth") > 0, "nested").when(F.col("event").isNotNull(), "event").otherwise("main")
    key = F.concat_ws("::", "tree_key", "stream_key", F.col("ordinal").cast("string"))
    return both.withColumn("type", folded_name(F.col("type"))).withColumn("context", context).withColumn("command_key", key).withColumnRenamed("tree_key", "level_key")


def resource_references(commands: DataFrame, key: str = "command_key") -> DataFrame:
    """``(key, path, field, resource_id, wanted)``: leaves of commands whose field names a resource; nested commands have rows of their own."""
    own = commands.where("command_json is not null").select(key, "command_json")
    found = tree.leaves(own, key, "command_json").withColumn("field", F.regexp_extract("path", r"\.([A-Za-z0-9_]+)$", 1))
    wanted = F.create_map(*(F.lit(x) for pair in RESOURCE_FIELDS.items() for x in pair))
    nested = "|".join([*tree.NESTED, "options"])
    return found.where(F.col("field").isin(*RESOURCE_FIELDS) & ~F.col("path").rlike(rf"\.({nested})\[")).select(key, "path", "field", F.col("value").alias("resource_id"), F.element_at(wanted, F.col("field")).alias("wanted"))


def level_references(levels: DataFrame, change=None, key: str = "level_key", text: str = "level_json") -> DataFrame:
    """:func:`resource_references` of :func:`level_commands`, in one walk that writes no command; with ``change`` those after it."""
    found = tree.level_leaves(levels, key, text, tuple(RESOURCE_FIELDS), (*tree.NESTED, "options"), change)
    wanted = F.create_map(*(F.lit(x) for pair in RESOURCE_FIELDS.items() for x in pair))
    place = F.concat_ws("::", "tree_key", "stream_key", F.col("ordinal").cast("string"))
    return found.select(place.alias("command_key"), "path", "field", F.col("value").alias("resource_id"), F.element_at(wanted, F.col("field")).alias("wanted"))


def reference_problems(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """References to no resource (``unresolved``), or to one of another kind; ``media`` takes four kinds."""
    joined = references.join(catalog.select(F.col("id").alias("resource_id"), F.col("type").alias("kind")), "resource_id", "left")
    fits = F.when(F.col("wanted") == "media", F.col("kind").isin(*MEDIA)).otherwise(F.col("kind") == F.col("wanted"))
    return joined.withColumn("problem", F.when(F.col("kind").isNull(), "unresolved").when(~fits, "wrong_kind")).where("problem is not null")


def level_resources(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """Declared and used resources of each level, sorted, with stand-ins (``placeholder``) for those that no catalog has."""
    level = F.regexp_extract("command_key", r"^(.*?::\d+::.*?)::(main|event/)", 1)
    used = references.select(level.alias("level_key"), "resource_id", "wanted").distinct()
    joined = used.join(catalog.select(F.col("id").alias("resource_id"), F.col("type").alias("kind")), "resource_id", "left")
    rows = joined.groupBy("level_key", "resource_id").agg(F.coalesce(F.min("kind"), F.min("wanted")).alias("kind"), F.min(F.col("kind").isNull()).alias("placeholder"))
    return rows.select("level_key", "resource_id", "kind", "placeholder")


def _text(path: str, json: str = "command_json") -> Column:
    return F.expr(f"coalesce(try_variant_get(try_parse_json({json}), '$.parameters.{path}', 'string'), try_variant_get(try_parse_json({json}), '$.{path}', 'string'))")


def _size(path: str) -> Column:
    """Entries of a list, null where there is none."""
    return F.expr(f"size(try_variant_get(try_parse_json(command_json), '$.parameters.{path}', 'array<variant>'))")


def signal_graph(commands: DataFrame, levels: DataFrame) -> DataFrame:
    """Edges (level, producer, signal, listening event); listeners are events with a custom trigger on the signal."""
    emits = commands.where("type = 'EMIT_SIGNAL'").select("level_key", "command_key", _text("signal").alias("signal")).where("signal is not null").distinct()
    return emits.join(listeners(levels), ["level_key", "signal"])


def listeners(levels: DataFrame) -> DataFrame:
    events = levels.select("level_key", F.explode(F.expr("try_variant_get(try_parse_json(level_json), '$.events', 'array<variant>')")).alias("e"))
    triggers = events.select("level_key", _event_name("e").alias("event"), F.explode(F.expr("try_variant_get(e, '$.triggers', 'array<variant>')")).alias("t"))
    return triggers.where("try_variant_get(t, '$.type', 'string') = 'custom'").select("level_key", "event", F.expr("try_variant_get(t, '$.target', 'string')").alias("signal")).distinct()


def signal_problems(commands: DataFrame, levels: DataFrame, mode: str = "complete_patch") -> DataFrame:
    """Signals that only one side knows: errors in a complete patch, warnings where the level around it may have the other side."""
    emits = commands.where("type = 'EMIT_SIGNAL'").select("level_key", _text("signal").alias("signal")).where("signal is not null").distinct()
    heard = listeners(levels).select("level_key", "signal").distinct()
    both = emits.withColumn("emitted", F.lit(True)).join(heard.withColumn("heard", F.lit(True)), ["level_key", "signal"], "full").where("emitted is null or heard is null")
    severity = {"complete_patch": "error", "level_context": "warning"}[mode]
    return both.select("level_key", "signal", F.when(F.col("heard").isNull(), "no_listener").otherwise("never_emitted").alias("problem"), F.lit(severity).alias("severity"))


def reachable_events(commands: DataFrame, levels: DataFrame, save) -> DataFrame:
    """Events that the main commands of a level set off, over any number of signals: a join a round until nothing is new.

    ``save(df)`` writes a table and reads it back, so that a round does not repeat those before it.
    """
    emits = commands.where("type = 'EMIT_SIGNAL'").select("level_key", "event", _text("signal").alias("signal"))
    edges = save(emits.join(listeners(levels).withColumnRenamed("event", "target"), ["level_key", "signal"]).select("level_key", "event", "target").distinct())
    found = save(edges.where("event is null").select("level_key", F.col("target").alias("event"), F.lit(1).alias("round")))
    front, number = found, 1
    while not front.isEmpty():
        number += 1
        step = front.select("level_key", "event").join(edges, ["level_key", "event"]).select("level_key", F.col("target").alias("event")).distinct()
        front = save(step.join(found, ["level_key", "event"], "left_anti").withColumn("round", F.lit(number)))
        found = save(found.unionByName(front))
    return found


def idle_levels(commands: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels to drop: a signal in the top list but no event, a condition with two empty branches, or a loop that only waits or breaks."""
    events = levels.select("level_key", F.expr("coalesce(size(try_variant_get(try_parse_json(level_json), '$.events', 'array<variant>')), 0)").alias("events"))
    deaf = commands.where("type = 'EMIT_SIGNAL' and stream_key = 'main'").select("level_key").distinct().join(events.where("events = 0"), "level_key").select("level_key", F.lit("signal_without_event").alias("reason"))
    empty = lambda f: F.coalesce(_size(f), F.lit(0)) == 0
    hollow = commands.where("type = 'IF_CONDITION'").where(empty("trueCommands") & empty("falseCommands")).select("level_key", F.lit("empty_condition").alias("reason"))
    body = F.expr("transform(coalesce(try_variant_get(try_parse_json(command_json), '$.parameters.commands', 'array<variant>'), array()), c -> upper(try_variant_get(c, '$.type', 'string')))")
    loops = commands.where("type = 'LOOP'").withColumn("body", body).where(F.size("body") > 0).where(F.size(F.array_except("body", F.array(F.lit("BREAK"), F.lit("WAIT")))) == 0).select("level_key", F.lit("idle_loop").alias("reason"))
    return deaf.unionByName(hollow).unionByName(loops).distinct()


def level_idle(levels: DataFrame, key: str = "level_key", text: str = "level_json") -> DataFrame:
    """:func:`idle_levels` of :func:`level_commands`, in one walk that writes no command; levels have unique keys."""

    def of(source):
        doc, found = tree._parsed(source), set()
        events = doc.get("events") if isinstance(doc, dict) else None
        for _, root, top in tree._lists(doc):
            for stream, _, _, command in tree.walk(top):
                kind, own = tree._folded(tree._type(command)), command.get("parameters")
                own = own if isinstance(own, dict) else {}
                filled = lambda field, own=own: own[field] if isinstance(own.get(field), list) else []
                if kind == "EMIT_SIGNAL" and root == stream == "main" and not (isinstance(events, list) and events):
                    found.add("signal_without_event")
                elif kind == "IF_CONDITION" and not filled("trueCommands") and not filled("falseCommands"):
                    found.add("empty_condition")
                elif kind == "LOOP" and filled("commands"):
                    types = [c.get("type") if isinstance(c, dict) else None for c in filled("commands")]
                    if all(isinstance(t, str) and t.upper() in ("BREAK", "WAIT") for t in types):
                        found.add("idle_loop")
        yield from ((reason,) for reason in sorted(found))

    return tree._expanded(levels, key, text, of, "reason string", "level_key")


def repaired_condition(json: Column) -> Column:
    """A command's condition with today's names.

    Older names are read where the new field is absent: branches ``then`` /
    ``thenCommands`` / ``commands`` and ``else`` / ``elseCommands``, in the
    parameters or beside them; ``variable`` or ``left`` for the key, ``right``
    for the value.
    """
    v = F.try_parse_json(json)
    first = lambda *paths: F.coalesce(*(F.try_variant_get(v, f"$.parameters.condition.{p}", "string") for p in paths))
    branch = lambda *names: F.coalesce(*(F.to_json(F.try_variant_get(v, f"$.{at}{n}", "array<variant>")) for n in names for at in ("parameters.", "")), F.lit("[]"))
    return F.struct(
        F.coalesce(first("type"), F.lit("variable")).alias("type"), first("key", "variable", "left").alias("key"), F.coalesce(first("operator"), F.lit("eq")).alias("operator"), first("value", "right").alias("value"),
        branch("trueCommands", "thenCommands", "then", "commands").alias("true_commands"), branch("falseCommands", "elseCommands", "else").alias("false_commands"),
    )


def compare(value: Column, operator: Column, wanted: Column) -> Column:
    """The eight condition operators on JSON texts, without conversions: ``1`` and ``"1"`` differ.

    Orderings hold between numbers, or between strings; ``in`` asks a list;
    ``contains`` compares as text.  Anything else is false, an unknown operator null.
    """
    a, b = F.try_parse_json(value), F.try_parse_json(wanted)
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, "$", "double"))
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    plain = lambda v: F.try_variant_get(v, "$", "string")
    kind = lambda v: F.when(number(v).isNotNull(), "number").otherwise(F.schema_of_variant(v))
    same = (kind(a) == kind(b)) & F.when(number(a).isNotNull(), number(a) == number(b)).otherwise(plain(a).eqNullSafe(plain(b)))
    ordered = lambda f: F.coalesce(f(number(a), number(b)), f(string(a), string(b)), F.lit(False))
    inside = F.exists(F.try_variant_get(b, "$", "array<variant>"), lambda x: (kind(x) == kind(a)) & F.when(number(a).isNotNull(), number(x) == number(a)).otherwise(plain(x).eqNullSafe(plain(a))))
    held = F.contains(F.coalesce(plain(a), value), F.coalesce(plain(b), wanted))
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(operator == "eq", no(same)).when(operator == "ne", ~no(same)).when(operator == "gt", ordered(lambda x, y: x > y)).when(operator == "lt", ordered(lambda x, y: x < y))
        .when(operator == "gte", ordered(lambda x, y: x >= y)).when(operator == "lte", ordered(lambda x, y: x <= y)).when(operator == "in", no(inside)).when(operator == "contains", no(held))
    )


def command_errors(commands: DataFrame) -> DataFrame:
    """Every broken rule of every command: its type, id and required parameters, its condition, its loop."""
    ids = F.count("*").over(Window.partitionBy("level_key", "id_"))
    rows = commands.withColumn("v_", F.try_parse_json("command_json")).withColumn("id_", F.expr("try_variant_get(v_, '$.id', 'string')")).withColumn("same_", ids)
    at = lambda p, kind="string": F.expr(f"try_variant_get(v_, '$.parameters.{p}', '{kind}')")
    is_if, is_loop, condition = F.col("type") == "IF_CONDITION", F.col("type") == "LOOP", at("condition.type")
    variable = is_if & (condition == "variable")
    missing = lambda p: at(p, "variant").isNull() | F.coalesce(at(p) == "", F.lit(False))
    problems = {
        "no_type": F.col("type") == "", "no_id": F.trim(F.coalesce("id_", F.lit(""))) == "", "id_twice": F.col("id_").isNotNull() & (F.col("same_") > 1),
        "branches_not_lists": is_if & (at("trueCommands", "array<variant>").isNull() | at("falseCommands", "array<variant>").isNull()),
        "old_branch_names": is_if & F.coalesce(*(at(p, "variant") for p in ("then", "else", "thenCommands", "elseCommands"))).isNotNull(),
        "condition_type": is_if & ~F.coalesce(condition.isin("variable", "expression"), F.lit(False)),
        "condition_incomplete": variable & (missing("condition.key") | missing("condition.operator") | missing("condition.value")),
        "condition_old_names": variable & F.coalesce(*(at(f"condition.{p}", "variant") for p in ("variable", "left", "right"))).isNotNull(),
        "condition_operator": variable & at("condition.operator").isNotNull() & ~at("condition.operator").isin(*OPERATORS),
        "empty_expression": is_if & (condition == "expression") & (F.trim(F.coalesce(at("condition.expression"), F.lit(""))) == ""),
        "empty_loop": is_loop & (F.coalesce(F.size(at("commands", "array<variant>")), F.lit(0)) == 0),
    }
    needed = [F.when((F.col("type") == kind) & missing(p), F.lit(f"missing:{p}")) for kind, ps in REQUIRED.items() for p in ps]
    errors = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in problems.items()), *needed))
    return rows.withColumn("errors", errors).where(F.size("errors") > 0).select("command_key", "level_key", "type", "errors")


def _broken_rules(kind: str, command: dict, same: int):
    """The rules of :func:`command_errors` that a command of a folded type breaks; ``same`` commands have its id."""
    own = command.get("parameters")
    own = own if isinstance(own, dict) else {}
    name, asked = tree._name(command.get("id")), own.get("condition")
    asked = asked if isinstance(asked, dict) else {}
    lacks = lambda values, field: field not in values or values[field] == ""
    if kind == "":
        yield "no_type"
    if not (name or "").strip(" "):
        yield "no_id"
    if same > 1:
        yield "id_twice"
    if kind == "IF_CONDITION":
        way, operator = asked.get("type"), tree._name(asked.get("operator"))
        rules = {
            "branches_not_lists": not all(isinstance(own.get(f), list) for f in ("trueCommands", "falseCommands")),
            "old_branch_names": any(f in own for f in ("then", "else", "thenCommands", "elseCommands")),
            "condition_type": way not in ("variable", "expression"),
            "condition_incomplete": way == "variable" and any(lacks(asked, f) for f in ("key", "operator", "value")),
            "condition_old_names": way == "variable" and any(f in asked for f in ("variable", "left", "right")),
            "condition_operator": way == "variable" and operator is not None and operator not in OPERATORS,
            "empty_expression": way == "expression" and not (tree._name(asked.get("expression")) or "").strip(" "),
        }
        yield from (rule for rule, bad in rules.items() if bad)
    if kind == "LOOP" and not (isinstance(own.get("commands"), list) and own["commands"]):
        yield "empty_loop"
    yield from (f"missing:{p}" for p in REQUIRED.get(kind, ()) if lacks(own, p))


def level_errors(levels: DataFrame, key: str = "level_key", text: str = "level_json") -> DataFrame:
    """:func:`command_errors` of :func:`level_commands`: a level is one document, so one walk counts its ids and asks all rules, and only broken commands have rows."""

    def of(source):
        found = [(f"{root}{stream[4:]}::{at}", tree._folded(tree._type(command)), command) for _, root, top in tree._lists(tree._parsed(source)) for stream, at, _, command in tree.walk(top)]
        ids = Counter(tree._name(command.get("id")) for _, _, command in found)
        del ids[None]
        for place, kind, command in found:
            errors = ",".join(_broken_rules(kind, command, ids[tree._name(command.get("id"))]))
            if errors:
                yield place, kind, errors

    rows = tree._expanded(levels, key, text, of, "place string, type string, errors string", "level_key")
    return rows.select(F.concat_ws("::", "level_key", "place").alias("command_key"), "level_key", "type", F.split("errors", ",").alias("errors"))


def missing_elements(commands: DataFrame, creators: tuple = CREATORS, dependents: tuple = DEPENDENTS) -> DataFrame:
    """Commands that use an element which no command of their level makes, by the types of a contract."""
    made = commands.where(F.col("type").isin(*creators)).select("level_key", _text("elementId").alias("element")).distinct()
    used = commands.where(F.col("type").isin(*dependents)).select("level_key", "command_key", _text("elementId").alias("element"))
    return used.join(made, ["level_key", "element"], "left_anti").select("command_key", "element")


def unbounded_loops(commands: DataFrame) -> DataFrame:
    """Loops without an end: no condition, or one on a variable that no command below them writes.

    What is below a loop shares its path as a prefix; an expression counts as an end.
    """
    is_loop = F.col("type") == "LOOP"
    prefix = F.concat_ws("/", "stream_key", F.col("ordinal").cast("string"), F.lit("commands"))
    rows = commands.where(F.col("type").isin("LOOP", "SET_VARIABLE")).select(
        "level_key", "command_key", is_loop.alias("loop"), F.when(is_loop, prefix).otherwise(F.col("stream_key")).alias("at"), F.coalesce(_text("condition.type"), F.lit("")).alias("kind"),
        F.when(is_loop, _text("condition.key")).otherwise(_text("key")).alias("key"), _text("condition.expression").alias("expression"), _text("op").alias("op"),
    )
    bad = F.expr("loop and (kind <> 'variable' and not (kind = 'expression' and trim(coalesce(expression, '')) <> '') or kind = 'variable' and key is null)")
    asked = F.expr("loop and kind = 'variable' and key is not null")
    writes = ~F.col("loop") & F.col("op").isin("add", "sub", "mul", "div", "set") & F.col("level_key").isNotNull()
    # loops meet the writes of their variable in one shuffle
    groups = rows.where(bad | asked | (writes & F.col("key").isNotNull())).groupBy("level_key", "key").agg(
        F.collect_list(F.when(bad, F.struct("command_key", "at"))).alias("bad"), F.collect_list(F.when(asked, F.struct("command_key", "at"))).alias("asked"), F.collect_set(F.when(writes, F.col("at"))).alias("writes"),
    )
    ended = lambda x: F.exists("writes", lambda w: (w == x["at"]) | F.startswith(w, F.concat(x["at"], F.lit("/"))))
    found = F.concat("bad", F.filter("asked", lambda x: ~ended(x)))
    return groups.select("key", F.explode(found).alias("x")).select("x.command_key", "key")


def readable(commands: DataFrame) -> DataFrame:
    """Levels as indented text, in the order of their paths."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "type")
    place = F.transform(F.split(F.concat_ws("/", "stream_key", F.col("ordinal").cast("string")), "/"), lambda x: F.lpad(x, 24, "0"))
    rows = commands.groupBy("level_key").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), line.alias("line")))).alias("lines"))
    return rows.select("level_key", F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("text"))


def with_modifiers(commands: DataFrame, modifiers: list[dict]) -> DataFrame:
    """Commands with those that modifiers place before them; what is inserted is not modified again.

    ``modifiers``: ``type`` (of the commands to find, aliases folded), ``insert``
    (the types to place before each, in order), and ``filter``, a map of paths
    and values that must all be equal: dotted paths from the command, plain ones
    from its parameters.  They are configuration, so they become one expression.
    """
    v = F.try_parse_json("command_json")

    def equal(path: str, wanted) -> Column:
        found = F.try_variant_get(v, f"$.{path}" if "." in path else f"$.parameters.{path}", "variant")
        return compare(F.coalesce(F.to_json(found), F.lit("")), F.lit("eq"), F.lit(json.dumps(wanted)))

    cases = []
    for m in modifiers:
        fits = folded_name(F.lit(m["type"])) == F.col("type")
        for path, wanted in (m.get("filter") or {}).items():
            if path.strip():
                fits = fits & equal(path.strip(), wanted)
        cases.append(F.when(fits, F.array(*(F.lit(t) for t in m["insert"]))).otherwise(F.array().cast("array<string>")))
    before = F.concat(*cases) if cases else F.array().cast("array<string>")
    new = F.concat(F.transform(before, lambda t: F.struct(t.alias("type"), F.lit(True).alias("inserted"))), F.array(F.struct("type", F.lit(False).alias("inserted"))))
    rows = commands.select("level_key", "stream_key", "ordinal", F.posexplode(new).alias("place", "c"))
    order = Window.partitionBy("level_key", "stream_key").orderBy("ordinal", "place")
    return rows.select("level_key", "stream_key", "ordinal", "c.type", "c.inserted", (F.row_number().over(order) - 1).alias("new_ordinal"))


def level_modified(levels: DataFrame, modifiers: list[dict], key: str = "level_key", text: str = "level_json") -> DataFrame:
    """:func:`with_modifiers` of :func:`level_commands`, in one walk that writes no command and numbers each list as it goes."""
    rules = [(tree._folded(m["type"]), tuple(m["insert"]), [(p.strip(), v) for p, v in (m.get("filter") or {}).items() if p.strip()]) for m in modifiers]
    absent = object()
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    whole = lambda v: json.dumps(v, sort_keys=True)

    def equal(command: dict, path: str, wanted) -> bool:
        found = command
        for part in path.split(".") if "." in path else ("parameters", path):
            found = found.get(part, absent) if isinstance(found, dict) else absent
        if number(found) and number(wanted):
            return float(found) == float(wanted)
        return found is not absent and type(found) is type(wanted) and whole(found) == whole(wanted)

    def of(source):
        placed: Counter = Counter()
        for _, root, top in tree._lists(tree._parsed(source)):
            for stream, at, _, command in tree.walk(top):
                kind, stream_key = tree._folded(tree._type(command)), root + stream[4:]
                before = [t for wanted, insert, conditions in rules if wanted == kind and all(equal(command, *x) for x in conditions) for t in insert]
                for n, t in enumerate([*before, kind]):
                    yield stream_key, at, t, n < len(before), placed[stream_key]
                    placed[stream_key] += 1

    return tree._expanded(levels, key, text, of, "stream_key string, ordinal int, type string, inserted boolean, new_ordinal int", "level_key")


def variable_types(writes: DataFrame) -> DataFrame:
    """Kind and mode of each variable from its writes ``(name, place, value, operation, scope)``: the last kind counts, two scopes are mixed."""
    number = F.col("operation").isin("add", "sub", "mul", "div") | F.col("value").try_cast("double").isNotNull()
    kind = F.when(number, "number").when(F.lower("value").isin("true", "false"), "boolean").otherwise("string")
    rows = writes.withColumn("kind", kind)
    return rows.groupBy("name").agg(F.max_by("kind", "place").alias("kind"), F.when(F.count_distinct("scope") > 1, "mixed").otherwise(F.min("scope")).alias("mode"))
