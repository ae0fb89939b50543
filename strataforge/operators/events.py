"""Signals, state and queues over an event table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators.pairs import paired


def signal_edges(producers: DataFrame, listeners: DataFrame, signal: str, producer: str, listener: str) -> DataFrame:
    """Distinct (producer, signal, listener) edges; each side is made distinct before the join, in which listeners come in blocks."""
    a = producers.select(signal, producer).distinct()
    b = listeners.select(signal, listener).distinct()
    return paired(a, b, [signal], [listener]).select(producer, signal, listener)


def unresolved_signals(emitted: DataFrame, heard: DataFrame, signal: str) -> DataFrame:
    """Signals that nobody hears, and those that nobody emits."""
    a, b = emitted.select(signal).distinct(), heard.select(signal).distinct()
    deaf = a.join(b, signal, "left_anti").withColumn("problem", F.lit("not_heard"))
    return deaf.unionByName(b.join(a, signal, "left_anti").withColumn("problem", F.lit("not_emitted")))


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    window = F.session_window(F.col(time).cast("timestamp"), gap)
    return df.groupBy(key, window.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


def debounce(df: DataFrame, key: str, time: str, gap_ms: int, tie: str | None = None) -> DataFrame:
    """Rows accepted when ``gap_ms`` has passed since the last accepted row of their key.

    Rows stream through each task in order, those of one time by ``tie``; only
    the last accepted time is held, so a frequent key needs no more memory than
    others.  From an accepted row a search leads straight to the next one.
    """

    def run(frames):
        last_key, last = None, None
        for frame in frames:
            keys, ms = frame[key].to_numpy(), frame["ms_"].to_numpy()
            keep = np.zeros(len(ms), dtype=bool)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(ms) else []
            for a, b in zip(first, [*first[1:], len(ms)], strict=True):
                at = a if keys[a] != last_key else a + np.searchsorted(ms[a:b], last + gap_ms)
                while at < b:
                    keep[at] = True
                    last = ms[at]
                    at += np.searchsorted(ms[at:b], last + gap_ms)
                last_key = keys[a]
            yield frame[keep].drop(columns="ms_")

    rows = df.withColumn("ms_", F.unix_millis(F.col(time).cast("timestamp")))
    return rows.repartition(key).sortWithinPartitions(key, "ms_", *([tie] if tie else [])).mapInPandas(run, df.schema)


def fold(df: DataFrame, key: str, order: str, op: str, value: str) -> DataFrame:
    """Final value of each key after its ``set`` and ``add`` operations in order; unset keys start at zero.

    Only what follows the last ``set`` counts, so two aggregations replace the ordered fold.
    """
    last_set = df.where(F.col(op) == "set").groupBy(key).agg(F.max(F.struct(order, value)).alias("s"))
    joined = df.join(last_set, key, "left")
    added = F.sum(F.when((F.col(op) == "add") & (F.col("s").isNull() | (F.col(order) > F.col(f"s.{order}"))), F.col(value)).otherwise(0))
    return joined.groupBy(key).agg((F.coalesce(F.max(f"s.{value}"), F.lit(0)) + added).alias("value"), F.count("*").alias("ops"))


def enqueued(tasks: DataFrame, wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The queue after a batch is put in: tasks that are there are not put in twice, those whose result exists are done, and failed or abandoned (running) ones start again.

    ``tasks`` has ``key``, ``status`` and ``attempts``; ``wanted`` and ``done`` have ``key``.
    """
    old = tasks.select(key, "status", "attempts")
    asked = wanted.select(key).distinct().withColumn("asked", F.lit(True))
    have = done.select(key).distinct().withColumn("have", F.lit(True))
    rows = old.join(asked, key, "full").join(have, key, "left")
    again = F.col("asked").isNotNull() & F.col("status").isin("failed", "running")
    status = F.when(F.col("have").isNotNull(), "done").when(F.col("status").isNull() | again, "queued").otherwise(F.col("status"))
    return rows.select(key, status.alias("status"), F.when(again, 0).otherwise(F.coalesce("attempts", F.lit(0))).alias("attempts"))


def queue_next_state(tasks: DataFrame, attempts: str, status: str, most: int) -> DataFrame:
    """The next state of each task: done stays, failures are tried again until ``most`` attempts."""
    again = F.when(F.col(attempts) < most, "queued").otherwise("failed")
    return tasks.withColumn("next_state", F.when(F.col(status) == "done", "done").when(F.col(status) == "running", again).otherwise("queued"))


def running_since_reset(df: DataFrame, key: str, order: str, absolute: Column, delta: Column) -> DataFrame:
    """Position after each move: the last absolute value plus the relative moves since."""
    window = Window.partitionBy(key).orderBy(order)
    era = F.count(F.when(absolute.isNotNull(), 1)).over(window)
    rows = df.withColumn("abs_", absolute).withColumn("delta_", delta).withColumn("era_", era)
    inside = Window.partitionBy(key, "era_").orderBy(order)
    at = F.coalesce(F.first("abs_").over(inside), F.lit(0.0)) + F.sum(F.when(F.col("abs_").isNull(), F.col("delta_")).otherwise(0.0)).over(inside)
    return rows.withColumn("position", at).drop("abs_", "delta_", "era_")
