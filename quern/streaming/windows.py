"""Streams of snapshots and events: windows with late data, sessions, distinct events, listing transitions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stamped(events: DataFrame, time: str = "ts") -> DataFrame:
    """Event time as a timestamp with a zone, as watermarks need it."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None, late: str, keys: list[str], measures: dict[str, Column], time: str = "ts") -> DataFrame:
    """Measures per window and key; events later than `late` are left out once their window has closed."""
    made = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = made.groupBy(w.alias("w"), *keys).agg(*(c.alias(n) for n, c in measures.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *measures)


def sessions(events: DataFrame, gap: str, late: str, keys: list[str], measures: dict[str, Column], time: str = "ts") -> DataFrame:
    made = events.withWatermark(time, late) if events.isStreaming else events
    out = made.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in measures.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *measures)


def distinct_events(events: DataFrame, keys: list[str], late: str, time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def transitions(snapshots: DataFrame, key: str, date: str = "date", value: str = "value", keep_ms: int | None = None) -> DataFrame:
    """Each snapshot's change against the last one of its listing, by state that holds one row per listing.

    A snapshot older than the state's is late: it gives no transition and does not replace the state. Of
    snapshots of one day the first counts. keep_ms: how long the state of a listing that is seen no more is
    kept; without it, it is kept for good. A listing that returns later starts anew.
    """

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["key", "previous_date", "date", "days", "eligible", "change"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame(columns=names)
            return
        rows = pd.concat([f[[date, value]] for f in frames]).dropna(subset=[date]).astype({value: "float64"}).drop_duplicates(date).sort_values(date)
        if state.exists:
            last = state.get
            rows = pd.concat([pd.DataFrame({date: [last[0]], value: [last[1]]}), rows[rows[date] > last[0]]])
        days = pd.to_datetime(rows[date]).diff().dt.days
        out = pd.DataFrame({"key": group[0], "previous_date": rows[date].shift(), "date": rows[date], "days": days, "eligible": days == 1, "change": rows[value].diff().where(days == 1)})
        if len(rows):
            state.update((rows[date].iloc[-1], float(rows[value].iloc[-1])))
            if keep_ms:
                state.setTimeoutDuration(keep_ms)
        yield out.iloc[1:].astype({"days": "int32"})

    kind = snapshots.schema[key].dataType.simpleString()
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return snapshots.groupBy(key).applyInPandasWithState(step, f"key {kind}, previous_date date, date date, days int, eligible boolean, change double", "date date, value double", "append", timeout)
