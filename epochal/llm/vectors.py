"""Vectors as rows and as blocks: what the two searches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from epochal.llm.common import materialize


def usable(table: DataFrame, zero: bool, scale: float = 1.0) -> DataFrame:
    """rid, vec_id, v (array of double): the rows whose vector is not null, is of the commonest length, and has components only that
    are finite, also if multiplied by scale; all-zero vectors only if asked for. rid numbers rows, so repeated ids stay apart; it is
    written, so it stays."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < F.lit(float("inf"))))
    if not zero:
        fine = fine & F.exists("v", lambda x: x != 0)
    rows = table.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine)
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "v"), "vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common[0] if common else 0))


def stored(table: DataFrame) -> str:
    """How components are kept as bytes without loss: as floats if they are floats, or else as doubles."""
    element = getattr(table.schema["embedding"].dataType, "elementType", None)
    return "<f4" if isinstance(element, FloatType) else "<f8"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most so many vectors, chosen by a hash of their id: bounded, and the same in each run."""
    got = rows.select("v").orderBy(F.xxhash64("vec_id", "rid")).limit(most).toArrow()
    return matrix(got.column("v").combine_chunks()) if got.num_rows else np.empty((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, k: int, slack: float = 0.0) -> np.ndarray:
    """The places of the k highest scores and of all within slack of the k-th."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack)


def runs(batches: Iterator[pa.RecordBatch], key: int, most: int) -> Iterator[list[np.ndarray | pa.Array]]:
    """The sorted rows of a partition in runs of equal key (a column's number), at most so many rows each."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.concat_batches([held, batch])
        at = 0
        keys = held.column(key).to_numpy(zero_copy_only=False)
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        for end in ends.tolist():
            while end - at >= most or (end < len(keys) and end > at):
                yield held.slice(at, min(most, end - at)).columns
                at += min(most, end - at)
        held = held.slice(at) if at < len(keys) else None
    if held is not None:
        yield held.columns
