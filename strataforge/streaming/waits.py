"""Waits for an event with a timeout, and listeners that hear once, on streams that come late and out of order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def waits(stream: DataFrame, key: str, time: str, kind: Column, start: str, end: str, timeout_ms: int, late: str = "10 seconds") -> DataFrame:
    """``(key, started_ms, ended_ms)``: for each ``start`` the first ``end`` of its key at or after it within the timeout, null if none comes.

    A wait is settled when the watermark (``late`` behind the newest event) has
    passed its end, so that events in any order up to that give the rows of
    :func:`strataforge.operators.assets.waits`; later ones are ignored.  Timers
    settle waits of keys that fall silent.  State holds open waits, and the ends
    that one of them may still take.
    """
    rows = stream.withWatermark(time, late).select(F.col(key).cast("long").alias("key"), F.col(time).alias("time"), F.unix_millis(time).alias("ms"), kind.alias("kind")).where(F.col("kind").isin(start, end))

    def step(group, batches, state: GroupState):
        opened, ends = ([list(x) for x in state.get] if state.exists else ([], []))
        if not state.hasTimedOut:
            for batch in batches:
                opened += batch.loc[batch.kind == start, "ms"].tolist()
                ends += batch.loc[batch.kind == end, "ms"].tolist()
        mark = state.getCurrentWatermarkMs()
        due = sorted(s for s in opened if s + timeout_ms < mark)
        opened, ends = sorted(s for s in opened if s + timeout_ms >= mark), sorted(set(ends))
        if due:
            took = [next((e for e in ends if s <= e <= s + timeout_ms), None) for s in due]
            yield pd.DataFrame({"key": [group[0]] * len(due), "started_ms": due, "ended_ms": pd.array(took, dtype="Int64")})
        # an end before the watermark and all open waits can be taken by none, for no earlier start is still to come
        ends = [e for e in ends if e >= min([mark, *opened])]
        if opened or ends:
            state.update((opened, ends))
            state.setTimeoutTimestamp(max(mark + 1, (opened[0] + timeout_ms if opened else ends[-1]) + 1))
        elif state.exists:
            state.remove()

    return rows.groupBy("key").applyInPandasWithState(step, "key long, started_ms long, ended_ms long", "opened array<long>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def heard_once(stream: DataFrame, listener: list[str], time: str, late: str = "10 seconds") -> DataFrame:
    """The first event of each listener in a watermark's span; those after it are not heard."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(listener)
