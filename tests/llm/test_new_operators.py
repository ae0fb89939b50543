"""Conversation repair, language identification and vector codes."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import language_id, shared, turn_repair, vector_codes
from tests.oracle import connect, difference

BLANK = " \t\n\x0b\x0c\r"


def plain_repair(turns):
    """Counts, cost, audit and lines of ``(turn, role, text)``: rounds over all labels until none changes."""
    steps, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        chars = [c for c in text if c not in BLANK]
        kind = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            counts[kind] += 1
        steps.append((role[:1], kind))
    # states: text of the initials so far, folded to what matters
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    labels = {(0, ""): (0, "")}
    while True:
        new = dict(labels)
        for (i, q), (cost, audit) in labels.items():
            options = [((i, after[q, r]), cost + 3, audit + "I") for r in "ua" if (q, r) in after]
            if i < len(steps):
                initial, kind = steps[i]
                options.append(((i + 1, q), cost + 4, audit + "D"))
                if kind not in ("blank", "duplicate"):
                    more = 3 if kind else 0
                    if (q, initial) in after:
                        options.append(((i + 1, after[q, initial]), cost + more, audit + "K"))
                    options += [((i + 1, after[q, r]), cost + 3 + more, audit + "R") for r in "ua" if (q, r) in after]
            for node, c, a in options:
                if node not in new or (c, a) < new[node]:
                    new[node] = (c, a)
        if new == labels:
            break
        labels = new
    n = len(steps)
    cost, audit = min(labels[n, q] for q in ("", "a") if (n, q) in labels)
    lines, q, rows = [], "", iter(turns)
    for c in audit:
        role, text = ("", "") if c == "I" else next(rows)[1:]
        if c in "IR":
            role = "assistant" if q == "u" else "user"
        if c != "D":
            q = after[q, role[:1]]
            lines.append(f"{role}:{text}")
    numbers = {t for t, _, _ in turns if t is not None}
    counts["gaps"] = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def plain_query(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    order = lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest())
    return {c: plain_repair(sorted(t, key=order)) for c, t in groups.items()}


def got(df):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


@pytest.mark.parametrize("seed", range(5))
def test_search_is_least(seed):
    r = random.Random(seed)
    for _ in range(60):
        turns = [(n, r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["a.", "b!", "open", "", "c?", f"{r.random()}."])) for n in range(r.randrange(9))]
        counts, audit = turn_repair.repaired(turns)
        lines = "\n".join(f"{role}:{text}" for c, _, role, text in turn_repair.replayed(turns, audit) if c != "D")
        assert counts | {"audit": audit, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()} == plain_repair(turns)


def test_repair_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_query(rows)
    assert got(turn_repair.op11_turn_repair(spark, sf_dir)) == want and len(want) > 10


def odd_rows():
    r = random.Random(3)
    text = lambda: r.choice([None, "", " \t", "Yes.", "open", f"Is it {r.random()}?", "é!\n"])
    rows = [(c, r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", None, "", "tool"]), text()) for c in (1, 2, None, -5) for _ in range(40)]
    return rows + rows[:10] + [(77, 20, "user", "x.")]


def test_repair_of_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls, ties, repeated rows, one-row conversations; whole in a task or in blocks, the result is one."""
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(odd_rows(), schema).withColumn("block", F.lit(1)).withColumn("edit", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain_query(odd_rows())
    assert got(turn_repair.op11_turn_repair(spark, str(tmp_path))) == want
    monkeypatch.setattr(turn_repair, "LONG_ROWS", 3)
    assert got(turn_repair.op11_turn_repair(spark, str(tmp_path))) == want


def test_long_conversation(spark):
    """A conversation of 3,000 turns, a third of them one text, is solved in blocks and equals the plain search."""
    r = random.Random(8)
    turns = [(n, r.choice(["user", "assistant"]), "Again." if r.random() < 0.33 else f"It is {n}" + r.choice([".", "", "?"])) for n in range(3000)]
    counts, lines = turn_repair.repair(spark.createDataFrame([(9, *t) for t in turns], "conv_id long, turn long, role string, text string"))
    (row,) = counts.collect()
    want, audit = turn_repair.repaired(turns)
    assert row.asDict() == {"conv_id": 9, **want, "audit": audit}
    shown = [(x.edit, x.turn, x.role, x.text) for x in lines.orderBy("block", "place").collect()]
    assert shown == list(turn_repair.replayed(turns, audit))


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert turn_repair.op11_turn_repair(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(c, 1, "user", "a.") for c in range(400)], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    dropped = [r for r in turn_repair.op11_turn_repair(spark, str(tmp_path)).collect() if zlib.crc32(f"{r.conv_id}:1".encode()) % 20 == 0]
    assert dropped and all(r.cost == 0 and r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in dropped)


def grams(text):
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    letters = re.sub(" +", " ", f" {letters} ")
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)}


def test_grams_and_kernel():
    texts = ["Ab, ab  ba", "x", "Été 12 été", "Ab ba", "ab" * 40]
    for stretch in (1 << 20, 5):
        language_id.STRETCH, own = stretch, language_id.Grams()
        assert [len(own.of(t)) for t in texts] == [len(grams(t)) for t in texts]
    language_id.STRETCH = 1 << 20
    own = language_id.Grams()
    marks = language_id.Landmarks([own.of(t) for t in texts[:3]])
    got = language_id.kernel_rows(own, marks, texts, marks.presence())
    want = [[len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))) for b in texts[:3]] for a in texts]
    assert np.allclose(got, want)


def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language_id.op12_string_kernel(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        text = docs[r.doc_id].text
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        if r.held_out and docs[r.doc_id].lang is not None and r.lang_pred != "und" and len(text) > 100:
            total += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert total > 150 and right / total > 0.95, (right, total)


def test_prediction_ignores_other_columns(spark):
    """Predictions are the same whatever else a row says, for texts of any kind."""
    sf = "/root/testdata/sf0.001"
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet").where(language_id.learnable()), 64, 16)
    texts = [None, "", "12 34", "the of and thing", "the of and thing", "日本 𠮷", "a" * 300_000, "der die und ein " * 100_000]
    one = spark.createDataFrame([(n, t, "de", 1) for n, t in enumerate(texts)], "doc_id long, text string, lang string, lettered int")
    two = spark.createDataFrame([(None, t, None, 2) for t in texts], "doc_id long, text string, lang string, lettered int")
    a = sorted((r.lang_pred, r.score) for r in language_id.predict(one, model, ["doc_id"]).collect())
    assert a == sorted((r.lang_pred, r.score) for r in language_id.predict(two, model, ["doc_id"]).collect())
    assert sum(p == "und" for p, _ in a) == 3
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = language_id.fit(empty)
    assert language_id.predict(empty, nothing, []).count() == 0
    assert {r.lang_pred for r in language_id.predict(one, nothing, ["doc_id"]).collect()} == {"und"}
    alone = language_id.fit(spark.createDataFrame([(1, "abc", "xx"), (2, "abc", "xx")], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.predict(one, alone, ["doc_id"]).collect()} == {"und", "xx"}


def test_codes_query(spark, sf_dir):
    assert difference(vector_codes.op13_grid_codes(spark, sf_dir), connect(sf_dir), vector_codes.ORACLE) == ""


@pytest.mark.parametrize("width", [1, 3, 4, 20])
def test_cells_find_the_nearest(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-90, 90, (64, width))
    entries[10] = entries[3]
    x = np.concatenate([rng.integers(-120, 120, (3000, width)), entries, np.full((1, width), vector_codes.LARGEST)])
    away = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    cells = vector_codes.Cells(entries)
    for _ in range(2):
        own, error = cells.nearest(x)
        assert (own == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()
    if width < 4:
        assert cells.evaluated < away.size


def plain_codes(rows):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1])
    cut = [p * width // 16 for p in range(17)]
    first = [v for i, v, _ in sorted((k for k in kept if k[0] is not None), key=lambda k: k[:2])[:64]]
    books = [[v[a:b] for v in first] for a, b in itertools.pairwise(cut)]
    near = lambda book, x: min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(2):
        for p, (a, b) in enumerate(itertools.pairwise(cut)):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(books[p], v[a:b])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(c) for c in zip(*own[n], strict=True)] if n in own else e for n, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [(i, [near(books[p], v[a:b]) for p, (a, b) in enumerate(itertools.pairwise(cut))], label) for i, v, label in kept]
    by_label = defaultdict(int)
    for _, f, label in found:
        by_label[label] += sum(e for e, _ in f)
    return sorted((repr(i), "".join(f"{n:02x}" for _, n in f), sum(e for e, _ in f), by_label[label], sha) for i, f, label in found)


@pytest.mark.parametrize("width", [16, 32, 40, 5])
def test_codes_of_odd_vectors(spark, tmp_path, width):
    """Bad vectors go; ties, repeated and null ids, null labels and other columns have defined results."""
    r = random.Random(width)
    rows = [(r.choice([None, *range(50)]), [round(r.gauss(0, 0.2), 2) for _ in range(width)], r.choice([None, 1, 2])) for _ in range(150)]
    rows += rows[:5] + [(1, None, 1), (2, [float("nan")] * width, 1), (3, [0.1] * (width - 1) + [None], 1), (4, [math.inf] * width, 2), (5, [0.0] * width, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).withColumn("whole", F.lit(1))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_grid_codes(spark, str(tmp_path)).collect()
    assert sorted((repr(g.vec_id), g.code, g.error, g.label_error, g.codebooks_sha256) for g in got) == plain_codes(rows)


def test_codes_of_unlike_lengths_and_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(n, [float(n % 7)] * (32 if n % 2 else 16), 0) for n in range(40)] + [(50, [], 0), (None, [1.0] * 8, 0)]
    codes, books = vector_codes.vector_codes(spark.createDataFrame(rows, schema))
    assert codes.count() == len(rows) and set(books) == {32, 16, 0, 8}
    assert codes.where("error > 0").count() == 0 or len(books[32]) == 20
    assert vector_codes.vector_codes(spark.createDataFrame([], schema))[0].count() == 0
    assert shared.shared_dir(spark)
