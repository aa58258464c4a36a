"""Streaming counterparts over labelled events: epochs, sliding windows, sessions, deduplication, enrichment and runs.

Each takes a streaming DataFrame and gives one; the same functions run on batches where Spark allows it. Event time must be a
TIMESTAMP for watermarks, so timestamps without zone are cast.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from epochal.sources.shared import new_path


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a single file is no base path of a stream
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """by, start, n: events per window."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"))
    return rows.select(*by, F.unix_seconds(F.col("window.start")).alias("start"), "n")


def sliding(stream: DataFrame, width: str, step: str, late: str, *by: str) -> DataFrame:
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), *by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.select(*by, F.unix_seconds(F.col("window.start")).alias("start"), "n", "mean")


def sessions(stream: DataFrame, gap: str, late: str, by: str) -> DataFrame:
    """by, start, n: runs of events no further apart than the gap."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
    return rows.select(by, F.unix_seconds(F.col("session_window.start")).alias("start"), "n")


def once(stream: DataFrame, key: str, late: str) -> DataFrame:
    """The first of the events with one key that arrive within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def enriched(stream: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """A stream-static join."""
    return stream.join(labels, on)


RUN = "user_id long, stage string, run long, n long"


def runs(stream: DataFrame) -> DataFrame:
    """user_id, stage, run, n: closed runs of equal event types per user in event order; state is the open run. Events of one trigger
    are put in order; across triggers they must arrive in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, run, n = state.get if state.exists else (None, 0, 0)
        kinds = pd.concat(list(frames)).sort_values(["ts", "event_id"])["event_type"]
        turns = kinds.ne(kinds.shift())
        turns.iloc[0] = kinds.iloc[0] != stage
        nth = turns.cumsum() + run
        found = pd.DataFrame({"stage": kinds, "run": nth}).groupby("run").agg(stage=("stage", "first"), n=("stage", "size"))
        if n and run in found.index:
            found.loc[run, "n"] += n
        elif n:
            found = pd.concat([pd.DataFrame({"stage": [stage], "n": [n]}, index=[run]), found])
        last = found.iloc[-1]
        state.update((last["stage"], int(found.index[-1]), int(last["n"])))
        closed = found.iloc[:-1]
        yield pd.DataFrame({"user_id": key[0], "stage": closed["stage"], "run": closed.index, "n": closed["n"]})

    rows = stream.select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, RUN, "stage string, run long, n long", "append", GroupStateTimeout.NoTimeout)


class OrderedRuns(StatefulProcessor):
    """Of one user: rows wait until the watermark has passed them, and are then taken in event order. State is the waiting rows, the open
    run, and one timer: for the first waiting row, or else for the end of the open run. A user without rows leaves no state."""

    def __init__(self, idle: int):
        self.idle = idle  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "stage string, start long, n long, last long")
        self.waiting = handle.getListState("waiting", "us long, event_id long, event_type string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [x for frame in rows for x in frame[["us", "event_id", "event_type"]].itertuples(index=False, name=None)]
        self.waiting.appendList([(int(us), int(i), str(kind)) for us, i, kind in new])
        first = min(us for us, _, _ in new) // 1000 + 1
        timer = next(self.handle.listTimers(), None)
        if timer is None or first < timer:
            self.wake(first)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        run, closed = tuple(self.open.get()) if self.open.exists() else None, []
        for us, _, kind in due:
            if run and (kind != run[0] or us > run[3] + self.idle):
                closed.append(run)
                run = None
            run = (kind, us if run is None else run[1], (run[2] if run else 0) + 1, us)
        if run and run[3] + self.idle <= now:
            closed.append(run)
            run = None
        self.waiting.put(later) if later else self.waiting.clear()
        self.open.update(run) if run else self.open.clear()
        if later or run:
            self.wake((later[0][0] if later else run[3] + self.idle) // 1000 + 1)
        return iter([pd.DataFrame([(key[0], stage, start, n) for stage, start, n, _ in closed], columns=["user_id", "stage", "start", "n"])] if closed else [])

    def wake(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def ordered_runs(stream: DataFrame, late: str, idle_seconds: int) -> DataFrame:
    """user_id, stage, start (microseconds of its first event), n: runs of equal event types per user in event order, however rows
    arrive within the watermark. A run ends with another type, or after so long without an event; both are known when the watermark
    has passed them. Start it inside rocksdb(spark): timers need that state store."""
    rows = stream.withWatermark("ts", late).select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "event_type")
    return rows.groupBy("user_id").transformWithStateInPandas(OrderedRuns(idle_seconds * 1_000_000), "user_id long, stage string, start long, n long", "append", "eventTime")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, beside the executor's heap."""
    before = {k: spark.conf.get(k) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives once all that is there now is processed: for complete mode the last result, else all rows."""
    spark = stream.sparkSession
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "complete":
        query = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    else:
        query = writer.outputMode(mode).format("parquet").option("path", out).start()
    query.awaitTermination()
    return spark.read.parquet(out) if mode == "complete" else spark.read.schema(stream.schema).parquet(out)
