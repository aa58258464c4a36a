"""What leaves the engine: tables ready to plot, and batches for a consumer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_points(sparse: DataFrame) -> DataFrame:
    """study_id, x, y, nth: two points per interval, which drawn in order are a hypnogram's steps."""
    ends = F.posexplode(F.array("init_sec", (F.col("init_sec") + F.col("duration_sec")).cast("int"))).alias("end", "x")
    return sparse.select("study_id", "init_sec", F.col("stage").alias("y"), ends).select("study_id", "x", "y", F.row_number().over(Window.partitionBy("study_id").orderBy("init_sec", "end")).alias("nth"))


def heat_map(matrix: DataFrame, classes: list[int]) -> DataFrame:
    """truth, and a column per predicted class."""
    return matrix.groupBy("truth").pivot("pred", classes).agg(F.first("n")).orderBy("truth")


def learning_curves(log: DataFrame, metrics: list[str], smooth: int = 1) -> DataFrame:
    """epoch, metric, value and its mean over the last epochs. log: epoch and a column per metric."""
    long = log.select("epoch", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    return long.withColumn("smoothed", F.avg("value").over(Window.partitionBy("metric").orderBy("epoch").rowsBetween(1 - smooth, 0)))


def tensors(windows: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of X (windows, periods, samples, channels) and y (windows, periods, 1), the last one shorter. windows: study_id, center,
    offset, signal (array of samples of arrays of channels), stage, in rows that are one window after another. Rows come partition by
    partition, so the driver holds one partition and one batch."""
    held_x: list = []
    held_y: list = []
    key, x, y = None, [], []

    def closed() -> None:
        held_x.append(np.asarray(x, dtype=np.float32))
        held_y.append(np.asarray(y, dtype=np.uint8)[:, None])

    rows = windows.repartition("study_id").sortWithinPartitions("study_id", "center", "offset")
    for row in rows.toLocalIterator(prefetchPartitions=True):
        if key is not None and (row.study_id, row.center) != key:
            closed()
            x, y = [], []
            if len(held_x) == size:
                yield np.stack(held_x), np.stack(held_y)
                held_x, held_y = [], []
        key = (row.study_id, row.center)
        x.append(row.signal)
        y.append(row.stage)
    if x:
        closed()
    if held_x:
        yield np.stack(held_x), np.stack(held_y)
