"""Conversations repaired by the cheapest edits of their turns.

An edit lattice has a node for each number of turns read and each state of the
role sequence ``(s?(ua)+)?``; edges keep, rename, delete or insert a turn.  A
bidirectional Dijkstra search runs a forward heap from the first node and a
reverse heap from the accepting ends.  It goes on until no path of the least
cost can still be open, joins all crossings of that cost, and takes the least
audit (the edits' initials in order).  Equally cheap audits of the same turns
are never prefixes of each other, so the least audit of a node is enough, and
pieces of a conversation can be solved apart.

A conversation of at most ``LONG_ROWS`` turns and ``LONG_CHARS`` characters is
solved in one task.  A longer one is dealt into ranges of its turns and solved
in blocks, from each state to each state; the blocks, a thousandth of its rows
or less, are then chained.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, materialize, table

#: A conversation beyond either is solved in blocks of at most LONG_ROWS distinct turns.
LONG_ROWS, LONG_CHARS = 512, 1 << 24
BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what a truncated turn adds where it stays.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Before any turn, after a system, a user, an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
KEPT = {(NONE, "s"): SYSTEM, **{(q, "u"): USER for q in (NONE, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")

LINES = "conv_id long, block long, place long, edit string, turn long, role string, text string"
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def renamed(state: int) -> int:
    """The state after a turn whose role is free: an assistant answers a user, all else is a user."""
    return ASSISTANT if state == USER else USER


@cache
def moves(initial: str | None, extra: int, copies: int) -> list[tuple[int, int, int, str]]:
    """``(state, next state, cost, letters)`` over a turn; ``initial`` None: its copies must all be deleted."""
    out = [(q, q, DELETE * copies, "D" * copies) for q in range(4)]
    if initial is not None:
        out += [(q, KEPT[q, initial], extra, "K") for q in range(4) if (q, initial) in KEPT]
        out += [(q, renamed(q), RENAME + extra, "R") for q in range(4)]
    return out


INSERTS = [(q, renamed(q), INSERT, "I") for q in range(4)]


def cheapest(steps: list[tuple[str | None, int, int]], start: int = NONE, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The least cost from ``start`` to one of ``ends`` over the steps, and the least audit of that cost.

    Nodes leave a heap by cost and, at equal cost, by their distance in turns
    from the heap's source: edges of cost zero always lead to another turn, so
    the label of a node is final when it leaves.
    """
    n = len(steps)
    labels = ({(0, start): (0, "")}, {(n, q): (0, "") for q in ends})
    final = ({(0, start)}, {(n, q) for q in ends})
    heaps = ([(0, 0, start)], [(0, 0, q) for q in ends])
    popped: tuple[set, set] = (set(), set())
    least = 0 if n == 0 and start in ends else math.inf

    def edges(side: int, i: int, q: int):
        """Nodes one edge on (or, on the reverse side, back), with cost and letters."""
        if side == 0:
            yield from ((i, to, w, c) for a, to, w, c in INSERTS if a == q)
            if i < n:
                yield from ((i + 1, to, w, c) for a, to, w, c in moves(*steps[i]) if a == q)
        else:
            yield from ((i, a, w, c) for a, to, w, c in INSERTS if to == q)
            if i:
                yield from ((i - 1, a, w, c) for a, to, w, c in moves(*steps[i - 1]) if to == q)

    while any(heaps):
        tops = [h[0][0] if h else math.inf for h in heaps]
        if sum(tops) > least:
            break
        side = 1 if tops[1] <= tops[0] else 0
        cost, layer, q = heapq.heappop(heaps[side])
        i = n - layer if side else layer
        if (i, q) in popped[side] or cost > labels[side][i, q][0]:
            continue
        popped[side].add((i, q))
        final[side].add((i, q))
        audit = labels[side][i, q][1]
        for j, to, w, letters in edges(side, i, q):
            new = (cost + w, letters + audit if side else audit + letters)
            if (j, to) in final[1 - side]:
                least = min(least, new[0] + labels[1 - side][j, to][0])
            old = labels[side].get((j, to))
            if old is None or new < old:
                labels[side][j, to] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(heaps[side], (new[0], n - j if side else j, to))
    if least == math.inf:
        return None
    found = [""] if n == 0 and start in ends and least == 0 else []
    for i, q in final[0]:
        cost, audit = labels[0][i, q]
        for j, to, w, letters in edges(0, i, q):
            if (j, to) in final[1] and cost + w + labels[1][j, to][0] == least:
                found.append(audit + letters + labels[1][j, to][1])
    return int(least), min(found)


def replayed(turns: list[tuple], audit: str, state: int = NONE):
    """``(edit, turn, role, text)`` for each letter; ``turns`` are ``(turn, role, text)``."""
    rows = iter(turns)
    for c in audit:
        turn, role, text = (None, "", "") if c == "I" else next(rows)
        if c in "IR":
            state = renamed(state)
            role = "assistant" if state == ASSISTANT else "user"
        elif c == "K":
            state = KEPT[state, role[:1]]
        yield c, turn, role, text


def fault(text: str, seen: bool) -> str | None:
    """A turn's first fault."""
    bare = text.rstrip(BLANKS)
    return "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None


def step_of(role: str, found: str | None) -> tuple[str | None, int, int]:
    return (None, 0, 1) if found in ("blank", "duplicate") else (role[:1], TRUNCATED if found else 0, 1)


def repaired(turns: list[tuple]) -> tuple[dict, str]:
    """Counts and audit of one conversation; ``turns`` are ``(turn, role, text)`` in order."""
    seen, steps, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in turns:
        found = fault(text, (role, text) in seen)
        seen.add((role, text))
        if found:
            counts[found] += 1
        steps.append(step_of(role, found))
    numbers = {t for t, _, _ in turns if t is not None}
    counts["gaps"] = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(turns, turns[1:], strict=False))
    counts["cost"], audit = cheapest(steps)
    return counts, audit


def _solve(batches):
    """Whole conversations, one after the other: a row of counts (``block`` null) and a row for each edit."""
    rows: list[dict] = []
    out: list[dict] = []

    def flush():
        turns = [(r["turn"], r["role"], r["text"]) for r in rows for _ in range(r["copies"])]
        counts, audit = repaired(turns)
        conv = rows[0]["conv_id"]
        out.append({"conv_id": conv, **counts, "audit": audit})
        out.extend({"conv_id": conv, "block": 0, "place": n, "edit": c, "turn": t, "role": role, "text": text} for n, (c, t, role, text) in enumerate(replayed(turns, audit)))
        rows.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["conv_id"] != rows[0]["conv_id"]:
                flush()
            rows.append(r)
            if len(out) >= 2000:
                yield _batch(out, SOLVED)
                out.clear()
    if rows:
        flush()
    yield _batch(out, SOLVED)


SOLVED = f"{LINES}, {COUNTS}"


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _numbered(batches):
    """Rows of a sorted range with their place in it, and blocks of them; ranges are in order of the tasks' numbers."""
    task, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        places = range(at, at + batch.num_rows)
        at += batch.num_rows
        block = pa.array([(task << 32) + p // LONG_ROWS for p in places], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, block, pa.array(list(places), pa.int64())], names=[*batch.schema.names, "block", "place"])


def _steps(r: dict) -> list[tuple[str | None, int, int]]:
    """Of a turn and its copies: those after the first are duplicates, or blank as the first is."""
    if r["gone"]:
        return [(None, 0, r["copies"])]
    return [(r["initial"], TRUNCATED if r["cut"] else 0, 1)] + ([(None, 0, r["copies"] - 1)] if r["copies"] > 1 else [])


BLOCKS = "conv_id long, block long, illegal long, first string, last string, start int, end int, cost long, audit string"


def _block(group: pa.Table) -> pa.Table:
    """A block solved from each state to each state."""
    rows = group.sort_by("place").to_pylist()
    steps = [s for r in rows for s in _steps(r)]
    initials = [r["initial"] for r in rows]
    illegal = sum(r["copies"] - 1 for r in rows) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    out = []
    for start in range(4):
        for end in range(4):
            found = cheapest(steps, start, (end,))
            if found:
                out.append({"conv_id": rows[0]["conv_id"], "block": rows[0]["block"], "illegal": illegal, "first": initials[0], "last": initials[-1], "start": start, "end": end, "cost": found[0], "audit": found[1]})
    return pa.Table.from_batches([_batch(out, BLOCKS)])


CHAINED = "conv_id long, block long, start int, illegal long, cost long, audit string"


def _chain(batches):
    """For each conversation the blocks' states on its cheapest path, and (``block`` null) its costs and whole audit."""
    conv, at, best, before, illegal, last = None, None, {}, {}, 0, ""

    def result():
        (cost, audit), end, chain = min((label, q, chain) for q, (label, chain) in best.items() if q in ENDS)
        yield {"conv_id": conv, "illegal": illegal, "cost": cost, "audit": audit}
        while chain:
            chain, block, start, piece = chain
            yield {"conv_id": conv, "block": block, "start": start, "audit": piece}

    for batch in batches:
        for r in batch.to_pylist():
            if at is not None and r["conv_id"] != conv:
                yield _batch(list(result()), CHAINED)
                at = None
            if at is None:
                conv, best, illegal, last = r["conv_id"], {NONE: ((0, ""), ())}, 0, None
            if at != r["block"]:
                before, best = best, {}
                illegal += r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
                at, last = r["block"], r["last"]
            if r["start"] in before:
                (cost, audit), chain = before[r["start"]]
                label = (cost + r["cost"], audit + r["audit"])
                if r["end"] not in best or label < best[r["end"]][0]:
                    best[r["end"]] = label, (chain, r["block"], r["start"], r["audit"])
    if at is not None:
        yield _batch(list(result()), CHAINED)


def _edited(rows: pa.Table, chosen: pa.Table) -> pa.Table:
    """The lines of one block."""
    rows, (way,) = rows.sort_by("place").to_pylist(), chosen.to_pylist()
    turns = [(r["turn"], r["role"], r["text"]) for r in rows for _ in range(r["copies"])]
    lines = replayed(turns, way["audit"], way["start"])
    return pa.Table.from_batches([_batch([{"conv_id": way["conv_id"], "block": way["block"], "place": n, "edit": c, "turn": t, "role": role, "text": text} for n, (c, t, role, text) in enumerate(lines)], LINES)])


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and lines of long conversations; equal rows are one row with a number of copies throughout."""
    bare = F.rtrim("text", F.lit(BLANKS))
    runs = rows.groupBy("conv_id", "turn", "role", "mark").agg(F.sum("copies").alias("copies"), F.first("text").alias("text"))
    runs = runs.withColumns({"initial": F.substring("role", 1, 1), "blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    runs = materialize(runs, "turn-runs")
    again = runs.groupBy("conv_id", "role", "mark").agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), F.col("first.turn").alias("first_turn"))
    same = runs.conv_id.eqNullSafe(again.c) & (runs.role == again.r) & (runs["mark"] == again.m)
    late = F.col("m").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    told = runs.join(again, same, "left").withColumn("gone", F.col("blank") | late)
    told = told.select("conv_id", "turn", "role", "mark", "text", "initial", "copies", "blank", "cut", "gone")
    kinds = "conv_id long, turn long, role string, mark string, text string, initial string, copies long, blank boolean, cut boolean, gone boolean, block long, place long"
    order = ["conv_id", "turn", "role", "mark"]
    turns = materialize(told.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, kinds), "turns")
    copies = F.col("copies")
    numbers = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), copies).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("gone"), copies).otherwise(copies - 1)).alias("duplicate"),
        F.sum(F.when(~F.col("gone") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    blocks = turns.select("conv_id", "block", "place", "initial", "copies", "cut", "gone").groupBy("conv_id", "block").applyInArrow(_block, BLOCKS)
    chained = materialize(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, CHAINED), "turn-chains")
    whole = chained.where("block is null").select(F.col("conv_id").alias("c"), "illegal", "cost", "audit")
    counts = numbers.join(whole, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    pieces = chained.where("block is not null").select("conv_id", "block", "start", "audit")
    shown = turns.select("conv_id", "block", "place", "turn", "role", "text", "copies")
    return counts, shown.groupBy("conv_id", "block").cogroup(pieces.groupBy("conv_id", "block")).applyInArrow(_edited, LINES)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by conversation, and the edited lines.

    ``conversations`` has ``conv_id``, ``turn``, ``role``, ``text`` and, if rows
    stand for several, ``copies``; a null role or text counts as one space, other
    columns are ignored.  Rows are taken by turn, nulls first, and within a turn
    by role and the SHA-256 of the text.  Rows without a ``conv_id`` are one
    conversation.  A role that is empty has no initial and is never kept as it
    is.  Counts: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``, for each conversation that has a row.  Lines: ``conv_id, block,
    place, edit, turn, role, text``, in order of ``block`` and ``place``;
    deleted ones have the edit ``D``.
    """
    if "copies" not in conversations.columns:
        conversations = conversations.withColumn("copies", F.lit(1))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"), F.col("copies").cast("long").alias("copies")).where("copies > 0")
    rows = rows.withColumn("mark", F.sha2("text", 256))
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    long_ones = materialize(sizes.where((F.col("n") > LONG_ROWS) | (F.col("chars") > LONG_CHARS)).select(F.col("conv_id").alias("c")), "long-conversations")
    order = ["conv_id", "turn", "role", "mark"]
    many = long_ones.count()
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    aside = F.broadcast(long_ones) if many <= BROADCAST_IDS else long_ones
    short = rows.join(aside, same, "left_anti") if many else rows
    solved = materialize(short.select(*order, "text", "copies").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_solve, SOLVED), "solved-turns")
    counts = solved.where("block is null").select("conv_id", *(x.split()[0] for x in COUNTS.split(", ")))
    lines = solved.where("block is not null").select(*(x.split()[0] for x in LINES.split(", ")))
    if many:
        more_counts, more_lines = _long(rows.join(aside, same, "left_semi"))
        counts, lines = counts.unionByName(more_counts), lines.unionByName(more_lines)
    return counts, lines


def _digests(batches):
    """The SHA-256 of each conversation's lines, fed line by line: a task holds one line at a time."""
    conv, sha, out = None, None, []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if sha is None or conv_id != conv:
                if sha is not None:
                    out.append({"conv_id": conv, "sha": sha.hexdigest()})
                conv, sha = conv_id, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield _batch(out, "conv_id long, sha string")
        out.clear()
    yield _batch(out + ([{"conv_id": conv, "sha": sha.hexdigest()}] if sha is not None else []), "conv_id long, sha string")


def digests(lines: DataFrame) -> DataFrame:
    """``(conv_id, sha)`` of the lines that stay, as ``role:text`` joined by newlines."""
    kept = lines.where("edit <> 'D'").select("conv_id", "block", "place", "role", "text")
    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").mapInArrow(_digests, "conv_id long, sha string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows that are dropped, emptied, cut, repeated or renamed by the CRC-32 of ``conv_id:turn``; null parts are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    role = F.when(kind == 4, "user").otherwise(part("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    counts, lines = repair(damaged(rows))
    shas = digests(lines).select(F.col("conv_id").alias("d"), "sha")
    every = rows.select("conv_id").distinct()
    found = counts.withColumnRenamed("conv_id", "c")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
