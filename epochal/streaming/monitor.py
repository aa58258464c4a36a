"""Counters of a running job: observed as rows pass, batch by batch, without a pass of their own."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

COUNTERS = ("tp", "relevant", "selected")
SCHEMA = "batch long, class int, tp long, relevant long, selected long"


def counted(pairs: DataFrame, classes: int, into: str | Observation) -> DataFrame:
    """pairs (truth, pred), observed: for each class how many are right, are of it, and are taken for it."""
    truth, pred = F.col("truth"), F.col("pred")
    of = lambda c: {"tp": (truth == c) & (pred == c), "relevant": truth == c, "selected": pred == c}
    return pairs.observe(into, *(F.count(F.when(hit, 1)).alias(f"{k}_{c}") for c in range(classes) for k, hit in of(c).items()))


def rows_of(batch: int, found: dict) -> list[tuple]:
    classes = sorted({int(k.rsplit("_", 1)[1]) for k in found})
    return [(batch, c, *(found[f"{k}_{c}"] for k in COUNTERS)) for c in classes]


class CounterLog(StreamingQueryListener):
    """Appends the counters of every batch of the queries that observe them under this name to a table, as soon as the batch is done.
    A batch that is run again is the same batch, so readers take each batch once. Use it as a context."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.ended, self.queries = threading.Condition(), set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and event.progress.numInputRows:
            self.spark.createDataFrame(rows_of(event.progress.batchId, found.asDict()), SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.queries.add(str(event.runId))
            self.ended.notify_all()

    def awaited(self, query, seconds: float = 120) -> None:
        """Waits for the end of a query and of what this listener has to write for it."""
        query.awaitTermination()
        with self.ended:
            if not self.ended.wait_for(lambda: str(query.runId) in self.queries, seconds):
                raise TimeoutError(f"no end of {query.runId} was heard within {seconds} s")

    def __enter__(self) -> CounterLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)


def counters(spark: SparkSession, path: str) -> DataFrame:
    """class, tp, relevant, selected: over all batches of the table, each taken once."""
    rows = spark.read.schema(SCHEMA).parquet(path).groupBy("batch", "class").agg(*(F.max(c).alias(c) for c in COUNTERS))
    return rows.groupBy("class").agg(*(F.sum(c).alias(c) for c in COUNTERS))
