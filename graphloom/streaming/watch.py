"""Watching a repository: bursts of change events become one sync each; errors that repeat the one on show stay hidden.

On streams both are stateful processors (transformWithState): a burst is kept per key until a timer for the quiet time
goes off, and each session remembers the error last shown. They need the RocksDB state store, which stateful_conf() names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.lineage import scratch
from ..plans.analysis import sync
from .source import IGNORED, change_events

# The quiet time that ends a burst, and the seconds within which an error on show is not repeated.
QUIET, REPEAT = "250 milliseconds", 3.0
BURST = "start timestamp, end timestamp, n long"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stateful_conf(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def relevant(events: DataFrame) -> DataFrame:
    return events.where((F.col("path") != "") & ~F.replace("path", F.lit("\\"), F.lit("/")).rlike(IGNORED))


def bursts(events: DataFrame, quiet: str = QUIET, late: str = "1 second") -> DataFrame:
    """(start, end, n) by event time: events closer together than the quiet time are one burst; on a stream the watermark bounds the state."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")


class Debounce(StatefulProcessor):
    """A key's burst goes out once nothing has come for the quiet time (of the cluster's clock): a timer that each event sets anew."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("burst", "start timestamp, end timestamp, n long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start = end = None
        n, timer = 0, None
        if self.held.exists():
            start, end, n, timer = self.held.get()
        for part in rows:
            if len(part):
                first, last = part["ts"].min().to_pydatetime(), part["ts"].max().to_pydatetime()
                start, end, n = first if start is None else min(start, first), last if end is None else max(end, last), n + len(part)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet
        self.handle.registerTimer(timer)
        self.held.update((start, end, n, timer))
        yield pd.DataFrame({"start": pd.Series([], dtype="datetime64[us]"), "end": pd.Series([], dtype="datetime64[us]"), "n": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, end, n, _ = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"start": [start], "end": [end], "n": [n]})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet: str = QUIET) -> DataFrame:
    """A stream of bursts (start, end, n): each after the quiet time."""
    stateful_conf(events.sparkSession)
    ms = round(pd.Timedelta(quiet).total_seconds() * 1000)
    return events.select(F.lit(0).alias("key"), "ts").groupBy("key").transformWithStateInPandas(Debounce(ms), BURST, "append", "processingTime")


def watch(spark: SparkSession, root: str, index: str | None = None, on_sync: Callable[[dict], None] | None = None, checkpoint: str | None = None, quiet: str = QUIET, events: DataFrame | None = None) -> StreamingQuery:
    """Sync once after each burst of changes. Batches run one at a time, and what comes meanwhile is the next burst.

    The sync itself compares contents, so an event that changed nothing costs a status and no more. With a checkpoint, the listings of
    the source are kept beside it, and a restart sees what changed meanwhile."""
    def react(batch: DataFrame, _: int) -> None:
        if batch.count():  # reads every partition, as each must commit its state
            result = sync(batch.sparkSession, root, index)
            if on_sync is not None:
                on_sync(result)

    where = checkpoint.rstrip("/") if checkpoint else scratch(spark)
    seen = relevant(events if events is not None else change_events(spark, root, f"{where}/listings"))
    return debounced(seen, quiet).writeStream.foreachBatch(react).option("checkpointLocation", f"{where}/query").start()


def _shown(last: tuple | None, said: str, at: float, window: float) -> bool:
    return last is None or last[0] != said or at - last[1] > window


class FreshErrors(StatefulProcessor):
    """A session's error goes out unless it is the one last shown, within the window."""

    def __init__(self, window: float):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("shown", "said string, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = tuple(self.last.get()) if self.last.exists() else None
        for part in rows:
            part = part.sort_values("at", kind="stable")
            keep = []
            for operation, message, at in zip(part["operation"], part["message"], part["at"], strict=True):
                said = f"{operation}:{message}"
                keep.append(_shown(last, said, at, self.window))
                last = (said, float(at)) if keep[-1] else last
            if last is not None:
                self.last.update(last)
            yield part[keep]

    def close(self) -> None:
        pass


def fresh_errors(errors: DataFrame, window: float = REPEAT) -> DataFrame:
    """errors(session, operation, message, at in seconds) without those that repeat, within the window, the error last shown in their session.

    What is shown depends on what was shown before, so a session is read in order: on a stream with one state a session, on a table as a sorted
    pass that holds one error at a time."""
    said = errors.select("session", F.coalesce("operation", F.lit("")).alias("operation"), F.coalesce("message", F.lit("")).alias("message"), F.col("at").cast("double").alias("at"))
    if errors.isStreaming:
        stateful_conf(errors.sparkSession)
        return said.groupBy("session").transformWithStateInPandas(FreshErrors(window), said.schema, "append", "none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last, begun = None, None, False
        for batch in batches:
            keep = []
            for own, operation, message, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not begun or own != session:
                    session, last, begun = own, None, True
                keep.append(_shown(last, f"{operation}:{message}", at, window))
                last = (f"{operation}:{message}", at) if keep[-1] else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    return said.repartition("session").sortWithinPartitions("session", "at", "operation", "message").mapInArrow(run, T.StructType(said.schema.fields))
