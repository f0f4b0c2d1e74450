"""Task runs as one stateful processor (G01, G02, G03, G08): value and list state, event-time timers, cancel marks and snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import shared_dir

#: A run that rests for so long has expired.
IDLE_MS = 86_400_000
#: Names of steps that a snapshot shows, the newest ones.
SHOWN = 3
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_COLUMNS = ["task", "run", "status", "steps", "started", "ended", "names"]
SCHEMA = "task long, run int, status string, steps long, started long, ended long, names string"


def _row(task: int, state: tuple, status: str, names: list[str]) -> tuple:
    run, steps, started, ended, cancelled = state
    gone = status == "cancelled"
    return (task, run, status if status != "open" else "cancelling" if cancelled else "running", 0 if gone else steps, started, ended, "" if gone else ",".join(names[-SHOWN:]))


class TaskRuns(StatefulProcessor):
    """A task's events (ts, event_id, kind, name) to its runs.

    A step begins a run if none is open. done and fail end it, and so does the step after a cancel, whose run keeps none
    of its steps (its partial output is withdrawn). A run that rests for IDLE_MS has expired, whether a later event or
    the watermark shows it. Each batch tells the ended runs and a snapshot of the open one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "run int, steps long, started long, ended long, cancelled boolean")
        self.count = handle.getValueState("count", "runs int")
        self.names = handle.getListState("names", "name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """State is read before a key's events and written after them, as each call to the store costs as much as many events."""
        task, out = key[0], []
        frames = list(rows)
        events = frames[0] if len(frames) == 1 else pd.concat(frames)
        ats, ids = events["ts"].to_numpy().astype("datetime64[us]").astype("int64"), events["event_id"].to_numpy()
        order = np.lexsort((ids, ats))
        kinds, said = events["kind"].to_numpy()[order].tolist(), events["name"].to_numpy()[order].tolist()
        before = state = self.open.get()
        counted = self.count.get()
        count = first = counted[0] if counted else 0
        names = [n for (n,) in self.names.get()] if state is not None else []
        for at, kind, name in zip(ats[order].tolist(), kinds, said, strict=True):
            if state is not None and at - state[3] > IDLE_MS * 1000:
                out.append(_row(task, state, "expired", names))
                state = None
            if kind == "cancel":
                if state is not None:
                    state = (*state[:3], at, True)
                continue
            if state is not None and state[4]:
                out.append(_row(task, state, "cancelled", names))
                state = None
            if state is None:
                count += 1
                state, names = (count, 1, at, at, False), []
            else:
                state = (state[0], state[1] + 1, state[2], at, False)
            names = [*names, name][-SHOWN:]
            if kind in ("done", "fail"):
                out.append(_row(task, state, "done" if kind == "done" else "failed", names))
                state = None
        if state is not None:
            out.append(_row(task, state, "open", names))
        if count != first:
            self.count.update((count,))
        self._keep(before, state, names)
        yield pd.DataFrame(dict(zip(_COLUMNS, map(list, zip(*out)), strict=True)) if out else {c: [] for c in _COLUMNS}, columns=_COLUMNS)

    def _keep(self, old: tuple | None, new: tuple | None, names: list[str]) -> None:
        if old is not None and (new is None or new[3] // 1000 != old[3] // 1000):
            self.handle.deleteTimer(old[3] // 1000 + IDLE_MS)
        if new is not None:
            self.open.update(new)
            self.names.put([(n,) for n in names])
            if old is None or new[3] // 1000 != old[3] // 1000:
                self.handle.registerTimer(new[3] // 1000 + IDLE_MS)
        elif old is not None:
            self.open.clear()
            self.names.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.open.get()
        if state is not None and state[3] // 1000 + IDLE_MS <= expiredTimerInfo.getExpiryTimeInMs():
            row = _row(key[0], state, "expired", [n for (n,) in self.names.get()])
            self.open.clear()
            self.names.clear()
            yield pd.DataFrame([row], columns=_COLUMNS)

    def close(self) -> None:
        pass


def runs(events: DataFrame, task: str = "task", at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Runs of a stream of events (task, ts, event_id, kind, name), by append; needs the RocksDB state store."""
    rows = events.withWatermark(at, late).groupBy(task)
    return rows.transformWithStateInPandas(TaskRuns(), SCHEMA, "Append", "EventTime")


def latest(told: DataFrame) -> DataFrame:
    """The last word on each run: how it ended, or its newest snapshot."""
    ended = ~F.col("status").isin("running", "cancelling")
    return told.groupBy("task", "run").agg(F.max_by(F.struct("status", "steps", "started", "ended", "names"), F.struct(ended, "ended", "steps")).alias("x")).select("task", "run", "x.*")


def replayed(spark: SparkSession, path: str, schema: str, events_of, late: str = "0 seconds") -> DataFrame:
    """Runs of all events that lie at path (a folder or a pattern) now: the stream is run until it has read them, its sink is a table in the shared folder."""
    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    where = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    try:
        told = runs(events_of(spark.readStream.schema(schema).parquet(path)), late=late)
        told.writeStream.format("parquet").option("path", f"{where}/told").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_STORE[0])
        else:
            spark.conf.set(_STORE[0], before)
    return latest(spark.read.schema(SCHEMA).parquet(f"{where}/told"))
