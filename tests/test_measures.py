"""Order statistics, resembling texts, blocks, exactly-once routing and waits, each against a plain form."""

from __future__ import annotations

import math
import random
import shutil
from difflib import SequenceMatcher
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataforge.operators import assets, ranks, segments, similar
from strataforge.plans import measures
from strataforge.streaming import routing, waits


@pytest.mark.parametrize("stretches", [2, 256])
def test_order_statistics(spark, stretches):
    r = random.Random(stretches)
    rows = [(g, r.choice([None, 5.0, r.gauss(0, 9), r.gauss(0, 9), float(r.randrange(4))])) for g in ["a", "b", None, "c"] for _ in range({"a": 700, "b": 1, None: 48, "c": 2}[g])] + [("d", None)]
    wanted = {f"n{q}": (ranks.nearest, q) for q in (0.05, 0.5, 0.95, 1.0)} | {f"e{q}": (ranks.half_even, q) for q in (0.1, 0.25, 0.5, 0.9)} | {f"c{q}": (ranks.cut, q) for q in (0.5, 0.95, 1.0)} | {"median": ("median", 0.5)}
    wanted = {k.replace(".", "_"): v for k, v in wanted.items()}
    got = {x.g: x.asDict() for x in ranks.order_statistics(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", wanted, stretches).collect()}
    values = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows}}
    assert set(got) == {g for g, v in values.items() if v}
    for g, v in values.items():
        n = len(v)
        for name, (of, q) in wanted.items() if n else ():
            at = {ranks.nearest: lambda: math.ceil(n * q) - 1, ranks.half_even: lambda: round((n - 1) * q), ranks.cut: lambda: int(n * q)}.get(of, lambda: None)()
            want = (v[(n - 1) // 2] + v[n // 2]) / 2 if at is None else v[min(n - 1, max(0, at))]
            assert got[g][name] == want, (g, name)
    assert ranks.order_statistics(spark.createDataFrame([], "g string, v double"), ["g"], "v", wanted).count() == 0
    alone = ranks.order_statistics(spark.createDataFrame(rows, "g string, v double"), [], "v", {"p": (ranks.nearest, 0.5)}).collect()
    every = sorted(v for _, v in rows if v is not None)
    assert [x.p for x in alone] == [every[math.ceil(len(every) * 0.5) - 1]]


def plain_pairs(rows, held, least):
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(t, []).append(i)
    return sorted((k, min(ids), len(ids), round(q, 9)) for k, h in held if h is not None for t, ids in texts.items() if (q := SequenceMatcher(None, h, t, autojunk=False).ratio()) >= least)


@pytest.mark.parametrize(("least", "block"), [(0.7, 2000), (0.3, 3), (1.0, 2000)])
def test_resembling_texts(spark, least, block):
    r = random.Random(4)
    base = ["".join(r.choice("abcd e") for _ in range(r.randrange(40))) for _ in range(25)] + ["", "a", "日本語の文", None]
    near = [(100 + i, "".join(c for c in t if r.random() > 0.15) + r.choice(["", "xy", "𠮷"])) for i, t in enumerate(base) if t is not None]
    rows = [*enumerate(base), *near, (500, base[3]), (501, "z" * 3000)]
    held = [(i, t) for i, t in enumerate(base) if i % 2 == 0 or t is None]
    df = lambda x: spark.createDataFrame(x, "i long, t string")
    got = similar.resembling(df(rows), "i", df(held), "i", "t", least, block).collect()
    assert sorted((g.held, g.row, g.copies, round(g.ratio, 9)) for g in got) == plain_pairs(rows, held, least)
    assert similar.resembling(df(rows), "i", df([]), "i", "t").count() == 0 == similar.resembling(df([]), "i", df(held), "i", "t").count()


def test_bounds_never_exceed_the_ratio():
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randrange(1, 30))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert similar.common_subsequence(a, similar._masks(b), len(b)) == table[-1][-1]


def test_resembling_passages_query(spark, sf_dir):
    """The query against all pairs."""
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    every = [x for x in rows if x[0] % 3] + [(i + 1_000_000, t[: len(t) * 7 // 10]) for i, t in rows]
    got = measures.resembling_passages(spark, sf_dir).collect()
    assert sorted((g.held, g.row, g.copies, g.ratio) for g in got) == plain_pairs(every, [x for x in rows if x[0] % 3 == 0], 0.7) and got


def test_blocks(spark):
    script = "SHOW a\nSHOW b\n\nON c\n  x\n  y\n\nNEXT\nTEXT\n\n\n" + "SET v\n" * 11 + "\tz\nWAIT 5\nEND"
    rows = spark.createDataFrame([(1, script), (2, None), (3, "\n \n"), (4, "a\r\nb")], "k int, t string")
    got = sorted((r.k, r.block, r.first_line, r.n_lines, r.body) for r in segments.script_blocks(rows, "k", "t").collect())
    assert [g[:4] for g in got] == [(1, 0, 0, 2), (1, 1, 3, 5), (1, 2, 11, 8), (1, 3, 19, 6), (4, 0, 0, 2)] and got[1][4] == "ON c\n  x\n  y\nNEXT\nTEXT" and got[3][4].endswith("WAIT 5\nEND")


def test_routing_happens_once(spark, tmp_path):
    """A stream is stopped between its result and its commit, and starts again; batches are also repeated by hand."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "id long, action string"
    route = F.coalesce("action", F.lit("errors"))
    add = lambda ids: spark.createDataFrame([(i, ["KEEP", "FIX", None][i % 3]) for i in ids], schema).coalesce(1).write.mode("append").json(source)

    def run():
        query = routing.route_stream(spark.readStream.schema(schema).json(source), out, check, route).trigger(availableNow=True).start()
        query.awaitTermination()

    assert routing.routed(spark, out, schema).count() == 0
    add(range(10))
    run()
    add(range(10, 25))
    run()
    want = sorted((i, ["KEEP", "FIX", "errors"][i % 3]) for i in range(25))
    rows = lambda: sorted((r.id, r.route) for r in routing.routed(spark, out, schema).collect())
    assert rows() == want and routing.committed(spark, out) == [0, 1]
    # the last batch is not known to be done: it comes again, and changes nothing
    for name in ("1", ".1.crc"):
        Path(check, "commits", name).unlink(missing_ok=True)
    run()
    assert rows() == want
    # its entry is lost, too, and half of its folder: it is written anew
    Path(out, "_ledger", f"{1:019d}.json").unlink()
    shutil.rmtree(Path(out, "batch=1", "route=FIX"))
    assert len(rows()) == 10
    for name in ("1", ".1.crc"):
        Path(check, "commits", name).unlink(missing_ok=True)
    run()
    assert rows() == want
    assert not routing.commit_routed(spark.createDataFrame([(99, "KEEP")], schema), 0, out, route) and rows() == want


def test_waits_equal_batch(spark, tmp_path):
    """Rows that come out of order within the watermark, absent ends and silent keys give the batch rows."""
    r = random.Random(6)
    rows = [(k, ms, r.choice(["ask", "answer", "other"])) for k in range(6) for ms in sorted(r.sample(range(0, 60_000), 12))]
    schema = "k long, ms long, kind string"
    batch = assets.waits(spark.createDataFrame(rows, schema).dropDuplicates(), "k", "ms", F.col("kind"), "ask", "answer", 5_000)
    want = sorted((x.k, x.ms, x.ended_ms or -1) for x in batch.collect())
    source = str(tmp_path / "in")
    rows.sort(key=lambda x: x[1] + r.uniform(0, 8_000))
    pieces = [rows[i : i + 9] for i in range(0, len(rows), 9)] + [[(99, 200_000, "other"), (99, 200_001, "ask")], [(99, 400_000, "ask")]]
    for piece in pieces:
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").json(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source).withColumn("at", F.timestamp_millis("ms"))
    query = waits.waits(stream, "k", "at", F.col("kind"), "ask", "answer", 5_000).writeStream.format("memory").queryName("waits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    got = sorted((x.key, x.started_ms, x.ended_ms or -1) for x in spark.table("waits").collect() if x.key != 99)
    assert got == want and any(e < 0 for *_, e in want) and any(e > 0 for *_, e in want)
    assert [(x.started_ms, x.ended_ms) for x in spark.table("waits").where("key = 99").collect()] == [(200_001, None)]
