"""Streaming twins of the event operators; the batch forms are in operators.events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, kind: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding windows; rows later than ``late`` behind the newest are dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return timed.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


def debounced(events: DataFrame, key: str, time: str, ident: str, gap_ms: int) -> DataFrame:
    """``(key, ident, ms)`` of accepted rows; the state of a key is its last accepted time."""

    def run(group, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ms", ident])
        keep = []
        for ms in rows["ms"]:
            ok = last is None or ms - last >= gap_ms
            if ok:
                last = int(ms)
            keep.append(ok)
        if last is not None:
            state.update((last,))
        yield rows.loc[keep, [key, ident, "ms"]]

    rows = events.select(key, ident, F.unix_millis(F.col(time).cast("timestamp")).alias("ms"))
    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {ident} {kinds[ident]}, ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def latest_values(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key so far; for complete or update mode."""
    return events.groupBy(key).agg(F.max(F.struct(order, value)).alias("row")).select(key, F.col(f"row.{value}").alias(value))
