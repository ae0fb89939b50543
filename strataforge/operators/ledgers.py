"""Review decisions, repairs and logs applied to a corpus, with every contradiction as a row; examples of coordination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.scalars import sha256_mod
from strataforge.operators import tree


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def reviewed(rows: DataFrame, decisions: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """``rows`` (``key``, ``intent``, ``program``) as reviewed: ``intent``, ``program``, ``kept`` and the first ``error``.

    Decisions (``status``) are PASS, EXCLUDE, QUERY_FIX, DSL_FIX and BOTH_FIX; a
    null field of a repair says nothing.  A repair must bring what its decision
    asks for, and must change it; one of a passed row is an error.  Rows with an
    error keep their texts.
    """
    d = decisions.select(F.col(key).alias("d_"), "status")
    r = repairs.select(F.col(key).alias("r_"), F.col("intent").alias("new_intent"), F.col("program").alias("new_program"), F.lit(True).alias("repaired"))
    joined = rows.join(d, _same(key, "d_"), "left").join(r, _same(key, "r_"), "left")
    query, program = F.col("status").isin("QUERY_FIX", "BOTH_FIX"), F.col("status").isin("DSL_FIX", "BOTH_FIX")
    intent, code = (F.trim(F.coalesce(f"new_{c}", c, F.lit(""))) for c in ("intent", "program"))
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    problems = [
        (F.col("status").isNull(), "not_reviewed"), (~F.col("status").isin("PASS", "EXCLUDE", "QUERY_FIX", "DSL_FIX", "BOTH_FIX"), "status"), ((F.col("status") == "PASS") & F.col("repaired").isNotNull(), "repaired_pass"),
        ((query | program) & F.col("repaired").isNull(), "missing_repair"), (query & F.col("new_intent").isNull(), "missing_intent"), (program & F.col("new_program").isNull(), "missing_program"),
        (query & (intent == plain("intent")), "same_intent"), (program & (code == plain("program")), "same_program"), ((query | program) & ((intent == "") | (code == "")), "empty"),
    ]
    error = F.coalesce(*(F.when(bad, name) for bad, name in problems))
    out = joined.withColumn("error", error).withColumn("use_", F.col("error").isNull() & (query | program))
    return out.select(key, F.when(F.col("use_"), intent).otherwise(F.col("intent")).alias("intent"), F.when(F.col("use_"), code).otherwise(F.col("program")).alias("program"), (F.col("error").isNull() & (F.col("status") != "EXCLUDE")).alias("kept"), "error")


def current_verdicts(log: DataFrame, key: str, order: str, verdict: str, clear: str = "clear") -> DataFrame:
    """The last verdict of each key; a key whose last entry is ``clear`` has none."""
    return log.groupBy(key).agg(F.max_by(F.col(verdict), F.col(order)).alias(verdict), F.max(order).alias(order)).where(F.col(verdict) != clear)


def merged_ledger(base: DataFrame, later: DataFrame, key: str, place: str) -> DataFrame:
    """The last row of each key, later ones before base ones, with ``rank_of`` 0 for keys of the base and 1 for new ones, and ``first_place`` there.

    Sorted by these two, keys stand where they were first seen.
    """
    both = base.withColumn("side_", F.lit(0)).unionByName(later.withColumn("side_", F.lit(1)))
    rest = [c for c in base.columns if c not in (key, place)]
    first = F.min(F.struct("side_", place)).alias("first_")
    last = F.max_by(F.struct(*rest), F.struct("side_", place)).alias("row_")
    return both.groupBy(key).agg(first, last).select(key, F.col("first_.side_").alias("rank_of"), F.col(f"first_.{place}").alias("first_place"), "row_.*")


def augmented(assets: Column, key: Column, ring: list[str], least: int) -> Column:
    """``assets`` (structs of ``id``, ``type``, ``path``) with as many of ``ring`` as bring its animations up to ``least``.

    The ring is read from the place that the hash of the key tells; paths that
    are there already are passed over.  An added one is named by its place in
    that order.  If the ring is too short, fewer are added.
    """
    n = len(ring)
    start = sha256_mod(F.concat(F.lit("animation:"), key.cast("string")), n)
    paths = F.transform(assets, lambda a: a["path"])
    there = F.size(F.filter(assets, lambda a: F.lower(a["type"]) == "animation"))
    ordered = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.concat(F.lit("injected_animation_"), (i + 1).cast("string")).alias("id"), F.lit("animation").alias("type"), F.element_at(F.array(*(F.lit(p) for p in ring)), ((start + i) % n + 1).cast("int")).alias("path")))
    new = F.filter(ordered, lambda a: ~F.coalesce(F.array_contains(paths, a["path"]), F.lit(False)))
    return F.concat(assets, F.slice(new, F.lit(1), F.greatest(F.lit(least) - there, F.lit(0))))


def recheck_pending(base: DataFrame, recheck: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` that the recheck (``verdict``, ``reason``) still finds bad, as pending repairs."""
    bad = recheck.where("verdict = 'STILL_BAD'").select(key, F.col("reason").alias("audit_reason"))
    return base.join(bad, key).withColumn("status", F.lit("PENDING"))


def recheck_problems(base: DataFrame, recheck: DataFrame, required: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """``(key, ledger, problem)``: all that keeps a rechecked view from being built.

    Required repairs must be those of the rows still bad, neither more nor less;
    extra ones must be of rows of the base; each repair fixes or excludes, gives
    a reason, and a fix a program; no ledger has a key twice, or none.
    """
    bad = recheck.where("verdict = 'STILL_BAD'").select(key).distinct()
    keys = lambda df: df.select(key).where(F.col(key).isNotNull()).distinct()
    say = lambda df, ledger, problem: df.select(key, F.lit(ledger).alias("ledger"), F.lit(problem).alias("problem"))
    found = [say(bad.join(keys(base), key, "left_anti"), "recheck", "not_in_base"), say(bad.join(keys(required), key, "left_anti"), "required", "missing"), say(keys(required).join(bad, key, "left_anti"), "required", "not_asked_for"), say(keys(extra).join(keys(base), key, "left_anti"), "extra", "not_in_base")]
    for name, df in (("base", base), ("recheck", recheck), ("required", required), ("extra", extra)):
        found.append(say(df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()), name, "key"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    for name, df in (("required", required), ("extra", extra)):
        rules = {"action": ~F.coalesce(F.col("action").isin("FIX", "EXCLUDE"), F.lit(False)), "no_reason": blank("reason"), "no_program": (F.col("action") == "FIX") & blank("program")}
        broken = F.array_compact(F.array(*(F.when(bad_, F.lit(n)) for n, bad_ in rules.items())))
        found.append(df.select(key, F.lit(name).alias("ledger"), F.explode(broken).alias("problem")))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def rechecked_view(base: DataFrame, required: DataFrame, extra: DataFrame, validation: DataFrame, key: str, content: list[str]) -> DataFrame:
    """``key``, ``action`` (KEEP, FIX, EXCLUDE), ``content`` as repaired, ``reason`` and ``split`` of every row of the base.

    Extra repairs come before required ones; a null field keeps the base's.  Rows
    of ``validation`` stay there, others train; excluded ones have no split.
    """
    names = ["action", "reason", *content]
    side = lambda df, n: df.select(key, *names, F.lit(n).alias("side_"))
    repairs = side(required, 0).unionByName(side(extra, 1)).groupBy(key).agg(F.max_by(F.struct(*names), "side_").alias("fix_"))
    rows = base.join(repairs, key, "left").join(validation.select(key, F.lit(True).alias("held_")).distinct(), key, "left")
    action = F.when(F.col("fix_.action") == "EXCLUDE", "EXCLUDE").when(F.col("fix_").isNotNull(), "FIX").otherwise("KEEP")
    rows = rows.withColumn("action", action)
    split = F.when(F.col("action") != "EXCLUDE", F.when(F.col("held_"), "validation").otherwise("train"))
    return rows.select(key, "action", *(F.trim(F.coalesce(F.col(f"fix_.{c}"), F.col(c))).alias(c) for c in content), F.col("fix_.reason").alias("reason"), split.alias("split"))


def _heard(events_field: str):
    """``(at, consumer, signal, enter, grp)`` of the signals that events listen to; ``enter`` and ``grp`` tell the first command in pre-order that emits one, in the commands (-1) or an event."""

    def of(source):
        doc = tree._parsed(source)
        if not isinstance(doc, dict):
            return
        events = doc.get(events_field)
        events = events if isinstance(events, list) else []
        emitted: dict[str, tuple] = {}
        number = 0
        for grp, top in [(-1, doc.get("commands")), *((n, e.get("commands")) for n, e in enumerate(events) if isinstance(e, dict))]:
            for _, _, _, command in tree.walk(top if isinstance(top, list) else []):
                number += 1
                inner = command.get("parameters")
                signal = inner.get("signal") if isinstance(inner, dict) else None
                if isinstance(signal, str) and signal and str(command.get("type", "")).upper() == "EMIT_SIGNAL":
                    emitted.setdefault(signal, (number, grp))
        for at, event in enumerate(events):
            triggers = event.get("triggers") if isinstance(event, dict) else None
            targets = [t.get("target") for t in triggers if isinstance(t, dict) and t.get("type") == "custom"] if isinstance(triggers, list) else []
            name = tree._name(event.get("id")) if targets else None
            for signal in dict.fromkeys(t for t in targets if isinstance(t, str) and t.strip(" ")):
                yield at, "None" if name is None else name, signal, *emitted.get(signal, (None, None))

    return of


def coordination_examples(levels: DataFrame, key: str, text: str, save, events_field: str = "events", direct: int = 3, derived: int = 3) -> DataFrame:
    """``(key, number, pattern, producer, signal, consumer)``: examples of coordinated events of each level.

    First ``direct`` signals that reach a listener, each consumer once, in the
    order of their emission (main commands before events); listeners without
    one fill up; then ``derived`` tasks on the level's listeners in turn.  A
    level without listeners has none.
    """
    # signals stay inside a level, so the walk that finds listeners tells the first emission that each of their signals has
    met = save(tree._expanded(levels.where(F.col(key).isNotNull()), key, text, _heard(events_field), "at int, consumer string, signal string, enter int, grp int", key))
    heard, edges = met.select(key, "at", "consumer", "signal"), met.where("enter is not null")
    first = edges.groupBy(key, "consumer").agg(F.min(F.struct("enter", "at", "grp", "signal")).alias("e"))
    place = Window.partitionBy(key)
    routed = first.withColumn("number", F.row_number().over(place.orderBy("e"))).where(F.col("number") <= direct)
    routed = routed.select(key, "number", F.lit("signal_routed_event").alias("pattern"), F.when(F.col("e.grp") < 0, "main").otherwise("event").alias("producer"), "e.signal", "consumer")
    listeners = heard.groupBy(key, "consumer").agg(F.min("at").alias("at"))
    none = F.lit(None).cast("string")
    spare = listeners.join(routed.select(key, "consumer"), [key, "consumer"], "left_anti").withColumn("n", F.row_number().over(place.orderBy("at")))
    taken = routed.groupBy(key).agg(F.count("*").cast("int").alias("taken"))
    fill = spare.join(taken, key, "left").withColumn("number", F.col("n") + F.coalesce("taken", F.lit(0))).where(F.col("number") <= direct)
    fill = fill.select(key, "number", F.lit("independent_signal_listener").alias("pattern"), none.alias("producer"), none.alias("signal"), "consumer")
    head = routed.unionByName(fill)
    # every event that listens is a source, also those of one name
    sources = heard.select(key, "at", "consumer").distinct().withColumn("n", F.row_number().over(place.orderBy("at")) - 1)
    count = sources.groupBy(key).agg(F.count("*").alias("sources")).join(head.groupBy(key).agg(F.count("*").alias("heads")), key)
    asked = count.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(derived - 1)))).withColumn("n", (F.col("i") % F.col("sources")).cast("int"))
    more = asked.join(sources, [key, "n"]).select(key, (F.col("heads") + F.col("i") + 1).cast("int").alias("number"), F.lit("derived_event_generalization").alias("pattern"), none.alias("producer"), none.alias("signal"), "consumer")
    return head.unionByName(more)
