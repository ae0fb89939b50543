from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataforge.operators import events
from strataforge.streaming import stateful


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def _run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_equal_batch(spark, sf_dir, stream):
    got = _run(stateful.windowed_counts(stream, "ts", "event_type", "1 day"), "w", "complete")
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").count()
    assert sorted(map(tuple, got.select("start", "event_type", "n").collect())) == sorted((r.w.start, r.event_type, r["count"]) for r in want.collect())


def test_debounce_equals_batch(spark, sf_dir, stream):
    got = _run(stateful.debounced(stream, "user_id", "ts", "event_id", 21_600_000), "d", "append")
    want = events.debounce(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts"), "user_id", "ts", 21_600_000)
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_latest_equals_batch(spark, sf_dir, stream):
    got = _run(stateful.latest_values(stream, "user_id", "event_id", "event_type"), "l", "complete")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = rows.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
