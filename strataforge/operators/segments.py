"""Scripts cut into blocks, and trees into fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators import tree

# Beginnings of lines that open a block, and of those that end one.
HEADS = ("ON ", "AUTO ", "EVENT ")
ENDINGS = ("NEXT", "SCENE ", "BGM ", "BGM_STOP", "SE ", "WAIT ")
#: A block of so many lines ends before the next line that is not indented; one of so few joins the block before it.
FULL, SHORT = 8, 2


def _numbered(text: str | None):
    """``(block, line, text)`` of the lines that are not blank; where a block ends depends on how long it has grown."""
    block, size, shut = 0, 0, False
    for n, line in enumerate((text or "").splitlines()):
        if not line.strip():
            shut = True
            continue
        top = not line[0].isspace()
        if size and (shut or (top and (size >= FULL or line.startswith(HEADS)))):
            block, size = block + 1, 0
        size, shut = size + 1, top and line.startswith(ENDINGS)
        yield block, n, line


def script_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, block, first_line, n_lines, body)``: whole scripts cut into blocks, from 0 in order.

    Blank lines end a block; lines that are not indented begin one if they open
    an event or the block is full, and end one if they leave the flow of
    commands.  A block of ``SHORT`` lines or fewer is then joined to what is
    before it.  Null and blank texts have no blocks.
    """
    lines = tree._expanded(df, key, text, _numbered, "piece int, line int, content string", key)
    pieces = lines.groupBy(key, "piece").agg(F.min("line").alias("first_line"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("body"))
    order = Window.partitionBy(key).orderBy("piece")
    opens = F.when((F.col("n") > SHORT) | (F.col("piece") == 0), 1).otherwise(0)
    pieces = pieces.withColumn("block", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    merged = pieces.groupBy(key, "block").agg(F.min("first_line").alias("first_line"), F.sum("n").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "body"))), lambda x: x["body"]), "\n").alias("body"))
    return merged.select(key, F.col("block").cast("int").alias("block"), "first_line", "n_lines", "body")


def tree_fragments(levels: DataFrame, key: str, text: str, events_field: str = "events") -> DataFrame:
    """``(key, suffix, fragment)``: each top command, each event, and each command of each event on its own, as JSON."""
    lists = lambda v, field: F.coalesce(F.try_variant_get(v, f"$.{field}", "array<variant>"), F.array().cast("array<variant>"))
    named = lambda name, v: F.struct(name.alias("suffix"), v.alias("v"))
    place = lambda head, i: F.concat(F.lit(head), (i + 1).cast("string"))
    docs = levels.select(key, F.expr(f"try_parse_json(`{text}`)").alias("v")).select(key, lists(F.col("v"), "commands").alias("top"), lists(F.col("v"), events_field).alias("events"))
    top = F.transform("top", lambda c, i: named(place("top", i), c))
    whole = F.transform("events", lambda event, e: named(place("event", e), event))
    inner = F.flatten(F.transform("events", lambda event, e: F.transform(lists(event, "commands"), lambda c, i: named(F.concat(place("event", e), place("-cmd", i)), c))))
    # a level is read once for all its parts
    return docs.select(key, F.explode(F.concat(top, whole, inner)).alias("part")).select(key, "part.suffix", F.to_json("part.v").alias("fragment"))


def single_commands(levels: DataFrame, key: str, text: str, without: tuple = ("SCRIPT",)) -> DataFrame:
    """``(key, number, type, fragment)``: every command at any depth as a fragment, numbered in pre-order from 1; commands without a type and those of ``without`` are left out."""
    found = tree.index_commands(levels, key, text)
    place = F.transform(F.split(F.concat_ws("/", "stream_key", F.col("ordinal").cast("string")), "/"), lambda x: F.lpad(x, 24, "0"))
    rows = found.withColumn("number", F.row_number().over(Window.partitionBy("tree_key").orderBy(place)))
    return rows.where((F.col("type") != "") & ~F.col("type").isin(*without)).select(F.col("tree_key").alias(key), "number", "type", F.col("command_json").alias("fragment"))


def distinct_fragments(fragments: DataFrame, key: str) -> DataFrame:
    """The first fragment of each text in the order of ``key`` and ``suffix``, with the number of its copies."""
    return fragments.groupBy("fragment").agg(F.min(F.struct(key, "suffix")).alias("first"), F.count("*").alias("copies")).select("first.*", "fragment", "copies")
