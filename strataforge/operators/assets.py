"""Asset catalogs, templated texts and judgements as column expressions; waits and assertions over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The lists of a resource document and the kind that each holds.
BUCKETS = {"images": "image", "audios": "audio", "animations": "animation", "videos": "video"}
# Fields of a judgement's scores.
SCORES = ("fidelity", "structure", "overall")


def flattened(df: DataFrame, key: str, json: str) -> DataFrame:
    """One catalog of the four lists: id (by default the name), type, path (``src`` or ``url``); the last entry of an id wins."""
    lists = [F.struct(F.lit(n).alias("part"), F.lit(kind).alias("type"), F.expr(f"try_variant_get(try_parse_json({json}), '$.{bucket}', 'array<variant>')").alias("list")) for n, (bucket, kind) in enumerate(BUCKETS.items())]
    rows = df.select(key, F.explode(F.array(*lists)).alias("b")).select(key, "b.part", "b.type", F.posexplode("b.list").alias("place", "v"))
    text = lambda p: F.expr(f"try_variant_get(v, '$.{p}', 'string')")
    rows = rows.select(key, F.coalesce(text("id"), text("name")).alias("id"), F.struct("part", "place").alias("at"), "type", F.coalesce(text("src"), text("url")).alias("path"))
    return rows.groupBy(key, "id").agg(F.max_by(F.struct("type", "path"), "at").alias("row")).select(key, "id", "row.type", "row.path")


def file_stem(path: Column) -> Column:
    """A readable id from a file name: unsafe runs as one underscore, trimmed, never empty."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]+", "_"), "^_+|_+$", "")
    return F.when(safe == "", "resource").otherwise(safe)


def greedy_ids(names: Column) -> Column:
    """Ids of an array of names in its order: the name, else with the first free number from 2 on, whoever took it."""

    def add(used: Column, name: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda k: F.when(k == 1, name).otherwise(F.concat(name, F.lit("_"), k.cast("string"))))
        return F.concat(used, F.slice(F.filter(tries, lambda t: ~F.array_contains(used, t)), 1, 1))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def interpolated(text: Column, values: Column) -> Column:
    """``{name}`` replaced from a map; null values count as empty, unknown names stay."""
    return F.aggregate(F.map_entries(values), text, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def first_json(text: Column) -> Column:
    """The first JSON object of a reply, from its first brace to the brace that closes it; null where none begins there.

    Fences and words around it, and whatever follows it, do not count: a parser
    of VARIANT stops after the first value.  The value has as many closing braces
    as its text, so that brace is found by their number; only a text that
    escapes braces is given anew, with sorted keys.
    """
    rest = F.when(F.instr(text, "{") > 0, F.substring(text, F.instr(text, "{"), F.length(text)))
    value = F.to_json(F.try_parse_json(rest))
    braces = F.length(value) - F.length(F.replace(value, F.lit("}")))
    found = F.concat(F.call_function("substring_index", rest, F.lit("}"), braces), F.lit("}"))
    return F.when(value.isNotNull(), F.when(F.contains(F.lower(rest), F.lit("\\u007d")), value).otherwise(found))


def category(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """The first category whose pattern the text matches."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def heading(dx: Column, dy: Column) -> Column:
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "down").otherwise("up"))


def trailing_number(name: Column) -> Column:
    """The three digits at the end of a name, 1 if there are none."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"(\d{3})$", 1), F.lit("")).cast("int"), F.lit(1))


def judgements(df: DataFrame, reply: str) -> DataFrame:
    """Replies of a judge as columns: winner, confidence, scores; ``errors`` lists what is broken."""
    scores = ", ".join(f"{s} double" for s in SCORES)
    parsed = F.from_json(first_json(F.col(reply)), f"winner string, confidence double, scores struct<{scores}>")
    rows = df.withColumn("judged_", parsed)
    score = lambda s: F.col(f"judged_.scores.{s}")
    tests = {"no_json": F.col("judged_").isNotNull(), "winner": F.col("judged_.winner").isin("A", "B", "tie", "neither"), "confidence": F.col("judged_.confidence").between(0, 1)} | {s: score(s).between(0, 10) for s in SCORES}
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in tests.items())))
    return rows.select(*df.columns, F.col("judged_.winner").alias("winner"), F.col("judged_.confidence").alias("confidence"), *(score(s).alias(s) for s in SCORES), errors.alias("errors"))


def waits(df: DataFrame, key: str, ms: str, kind: Column, start: str, end: str, timeout_ms: int) -> DataFrame:
    """For each ``start`` row the first ``end`` of its key at or after it within the timeout, null if none comes."""
    ahead = Window.partitionBy(key).orderBy(ms).rangeBetween(0, timeout_ms)
    return df.withColumn("ended_ms", F.min(F.when(kind == end, F.col(ms))).over(ahead)).where(kind == start)


def drops_from_outside(df: DataFrame, key: str, order: str, kind: Column, side: Column) -> DataFrame:
    """Drop rows whose drag began on the other side."""
    began = F.last(F.when(kind == "start", side), ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("began_", began).where((kind == "drop") & (F.col("began_") != side)).drop("began_")


def assertions(log: DataFrame, kind: str, wanted: DataFrame) -> DataFrame:
    """Assertions ``(event, test, n)`` on how often an event occurs: ``at_least``, ``exactly`` or ``never``."""
    seen = log.groupBy(F.col(kind).alias("event")).agg(F.count("*").alias("seen"))
    rows = wanted.join(seen, "event", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    ok = F.when(F.col("test") == "at_least", F.col("seen") >= F.col("n")).when(F.col("test") == "exactly", F.col("seen") == F.col("n")).when(F.col("test") == "never", F.col("seen") == 0)
    return rows.withColumn("passed", F.coalesce(ok, F.lit(False)))
