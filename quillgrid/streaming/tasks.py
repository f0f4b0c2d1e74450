"""Structured Streaming additions: deduplicated ingest, task state with time-out, windowed progress (beyond the reference)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Parquet files as they arrive, with a watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(at, late)


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once within the watermark: an idempotent ingest."""
    return events.dropDuplicatesWithinWatermark([key])


def progress_by_window(events: DataFrame, width: str = "1 hour", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events by tumbling window and type; late ones within the watermark count."""
    return events.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def task_states(events: DataFrame, key: str = "user_id", idle_ms: int = 86_400_000) -> DataFrame:
    """(task, events, last_type, expired): running state of each task, dropped after a day without events."""

    def step(ids: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, last, _ = state.get
            state.remove()
            yield pd.DataFrame([(ids[0], n, last, True)], columns=["task", "events", "last_type", "expired"])
            return
        n, last, newest = state.get if state.exists else (0, None, 0)
        for f in frames:
            n += len(f)
            f = f.sort_values(["ts", "event_id"])
            when = int(f["ts"].iloc[-1].value)
            if when >= newest:
                newest, last = when, f["event_type"].iloc[-1]
        state.update((n, last, newest))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(ids[0], n, last, False)], columns=["task", "events", "last_type", "expired"])

    return events.groupBy(key).applyInPandasWithState(step, "task long, events long, last_type string, expired boolean", "n long, last string, newest long", "update", GroupStateTimeout.ProcessingTimeTimeout)
