"""Joins with large results: whole, spread over tasks, and in an order that files hold in little room."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.functions import scalars
from strataforge.operators import events as ev
from strataforge.operators import space


def test_edges_of_one_signal_take_little_room(spark, tmp_path):
    producers = spark.range(40).select(F.when(F.col("id") < 0, "none").otherwise("s").alias("signal"), (F.col("id") * 2).alias("producer"))
    listeners = spark.range(30_000).select(F.when(F.col("id") < 0, "none").otherwise("s").alias("signal"), (F.col("id") * 3).alias("listener"))
    path = f"{tmp_path}/edges"
    ev.signal_edges(producers.unionByName(producers), listeners.unionByName(listeners), "signal", "producer", "listener").write.parquet(path)
    edges = spark.read.parquet(path)
    assert edges.count() == edges.distinct().count() == 40 * 30_000
    files = [f for f in (tmp_path / "edges").glob("*.parquet") if spark.read.parquet(str(f)).count()]
    assert len(files) > 1 and sum(f.stat().st_size for f in files) < 40 * 30_000 // 2


def test_edges_of_odd_rows(spark):
    schema = "signal string, {} int"
    producers = spark.createDataFrame([("a", 1), ("a", None), (None, 2), ("b", 3), ("a", 1)], schema.format("p"))
    listeners = spark.createDataFrame([("a", 5), ("a", None), (None, 6), ("c", 7)], schema.format("l"))
    got = sorted(((r.p, r.signal, r.l) for r in ev.signal_edges(producers, listeners, "signal", "p", "l").collect()), key=repr)
    assert got == [(1, "a", 5), (1, "a", None), (None, "a", 5), (None, "a", None)]
    assert ev.signal_edges(producers, listeners.where("false"), "signal", "p", "l").count() == 0


def test_rectangles_of_one_cell_meet_in_many_tasks(spark):
    box = spark.range(4000).select("id", (F.col("id") % 50 / 1000).alias("x0"), (F.col("id") % 7 / 1000).alias("y0")).select("*", (F.col("x0") + 0.1).alias("x1"), (F.col("y0") + 0.1).alias("y1"))
    found = space.overlaps(box.where("id < 300"), box, 0.25)
    assert found.count() == found.select("left_id", "right_id").distinct().count() == 300 * 4000
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_areas_of_rectangles_in_one_place_stand_in_runs(spark, tmp_path):
    # 1,200 places with four rectangles each, whose ids are far apart
    at = lambda seed: F.pmod(F.hash(F.col("id") % 1200, F.lit(seed)), F.lit(99_991)) / 1_000_000
    box = spark.range(4800).select("id", at(1).alias("x0"), at(2).alias("y0")).select("*", (F.col("x0") + 0.1).alias("x1"), (F.col("y0") + 0.1).alias("y1"))
    path = f"{tmp_path}/met"
    space.overlaps(box.where("id % 2 = 0"), box.where("id % 2 = 1"), 0.25).write.parquet(path)
    assert spark.read.parquet(path).count() == 2400 * 2400
    assert sum(f.stat().st_size for f in (tmp_path / "met").glob("*.parquet")) < 2400 * 2400 * 4


def test_rounded_as_spark_rounds(spark):
    values = [0.0, -0.0, 0.0000000005, -0.0000000005, 0.0049999995, 0.1234567885, 1e300, -2.5, float("nan"), float("inf"), float("-inf"), None, 12345.6789012345, 1e-300, *(i * 37e-12 - 0.005 for i in range(20_000))]
    x = F.col("x")
    same = scalars.rounded(x, 9).eqNullSafe(F.round(x, 9))
    assert spark.createDataFrame([(v,) for v in values], "x double").where(~same).count() == 0
