"""Streaming forms: sessions of intervals, job status with monotone progress, throttled logs.

Each takes a streaming DataFrame and returns one; the caller chooses sink and trigger. State is kept by key, and
is bounded by the watermark, or where rows carry no time (status) by one small row for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def interval_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes", key: str = "user_id", time: str = "ts") -> DataFrame:
    """Islands of events of each key with pauses below ``gap``; late rows count until the watermark passes them."""
    stamped = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(key, F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_report(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by kind over sliding windows."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def _progress(keep_ms: int | None):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, seen, at = state.get if state.exists else (0, 0, 0)
        for pdf in frames:
            best, seen = max(best, int(pdf["progress"].clip(0, 100).max())), seen + len(pdf)
            if keep_ms is not None:
                at = max(at, int(pdf["at"].max().timestamp() * 1000))
        state.update((best, seen, at))
        if keep_ms is not None:
            state.setTimeoutTimestamp(max(at + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "progress": [best], "n_updates": [seen]})

    return step


def job_progress(status: DataFrame, late: str = "10 minutes", keep_ms: int = 24 * 3_600_000) -> DataFrame:
    """The progress of each job (job string, progress long), which never falls. With a time ``at`` a job is forgotten once the watermark is
    ``keep_ms`` behind its last news; without, each job keeps one small row."""
    timed = "at" in status.columns
    rows = status.withWatermark("at", late) if timed else status
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("job").applyInPandasWithState(_progress(keep_ms if timed else None), "job string, progress long, n_updates long", "best long, seen long, at long", "update", timeout)


def _throttled(quiet: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        # A trigger's rows of a key come in several batches in any order: their times, 8 bytes each, are put in order as a whole.
        times = np.sort(np.concatenate([pdf["s"].to_numpy(np.int64, copy=True) for pdf in frames]))
        through, at = [], 0
        while at < len(times):
            if last is not None:
                at = int(np.searchsorted(times, last + quiet))
                if at == len(times):
                    break
            last = int(times[at])
            through.append(last)
            at += 1
        state.update((last,))
        state.setTimeoutTimestamp(max((last + quiet) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"signature": [key[0]] * len(through), "s": through})

    return step


def throttle(log: DataFrame, quiet: int = 30, late: str = "10 minutes") -> DataFrame:
    """Rows (signature string, s long, seconds) at least ``quiet`` after the last one of their signature that went through. Rows behind the
    watermark are dropped; a signature is forgotten when the watermark has passed its quiet time, as any row that may still come goes through."""
    timed = log.withColumn("at", F.timestamp_seconds("s")).withWatermark("at", late)
    return timed.groupBy("signature").applyInPandasWithState(_throttled(quiet), "signature string, s long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
