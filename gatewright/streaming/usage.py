"""The usage log as a stream: daily counts, sessions, quota, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(log: DataFrame, late: str) -> DataFrame:
    """Event time as an instant (a time without zone is UTC) with its watermark."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def daily_counts(log: DataFrame, late: str = "2 days") -> DataFrame:
    """Requests and errors per UTC day, final once the watermark has passed the day."""
    w = _timed(log, late).groupBy(F.window("ts", "1 day").alias("w"))
    return w.agg(F.count("*").alias("requests"), F.sum((F.col("status") == "error").cast("int")).alias("errors")).select(F.to_date("w.start").alias("day"), "requests", "errors")


def sliding_counts(log: DataFrame, size: str, step: str, late: str = "2 days") -> DataFrame:
    return _timed(log, late).groupBy(F.window("ts", size, step).alias("w"), "path").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "path", "n")


def sessions(log: DataFrame, gap: str, late: str = "2 days") -> DataFrame:
    return _timed(log, late).groupBy("email", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("email", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(log: DataFrame, key: str, late: str = "2 days") -> DataFrame:
    """Rows without repeats of the key within the watermark."""
    return _timed(log, late).dropDuplicatesWithinWatermark([key])


def quota(log: DataFrame, limit: int) -> DataFrame:
    """event_id, refused: a user's first `limit` requests of a day in order of arrival are taken. The state per user and
    day is one counter, dropped two days after the day in event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = state.get[0] if state.exists else 0
        for rows in frames:
            rows = rows.sort_values(["ts", "event_id"], kind="stable")
            place = taken + 1 + pd.RangeIndex(len(rows))
            taken += len(rows)
            yield pd.DataFrame({"event_id": rows["event_id"], "refused": [p > limit for p in place]})
        state.update((taken,))
        state.setTimeoutTimestamp(max(int(pd.Timestamp(key[1]).timestamp() * 1000) + 3 * 86_400_000, state.getCurrentWatermarkMs() + 1))

    marked = _timed(log, "2 days").withColumn("day", F.to_date("ts"))
    return marked.groupBy("email", "day").applyInPandasWithState(step, "event_id long, refused boolean", "taken long", "append", GroupStateTimeout.EventTimeTimeout)
