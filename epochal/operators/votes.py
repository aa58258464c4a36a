"""Combining the predictions of several voters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """The first place, from 0, of the highest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def hard(votes: DataFrame, *key: str) -> DataFrame:
    """key, pred: the commonest prediction; of equally common ones the least."""
    return votes.groupBy(*key).agg(F.mode("pred", True).alias("pred"))


def combined(scores: DataFrame, how: str, *key: str) -> DataFrame:
    """key, class, score: sum or mean of the voters' score arrays, class by class."""
    rows = scores.select(*key, F.posexplode("scores").alias("class", "score"))
    return rows.groupBy(*key, "class").agg(getattr(F, {"sum": "sum", "mean": "avg"}[how])("score").alias("score"))


def winner(combined_scores: DataFrame, *key: str, digits: int | None = None) -> DataFrame:
    """key, pred: the class of the highest score; of equal ones the first."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    return combined_scores.groupBy(*key).agg(F.max_by("class", F.struct(score, -F.col("class"))).alias("pred"))


def overlap_added(windows: DataFrame) -> DataFrame:
    """study_id, period_idx, class, score: the windows' scores summed where they fall. windows: study_id, start, offset, class, score."""
    placed = windows.withColumn("period_idx", (F.col("start") + F.col("offset")).cast("int"))
    return placed.groupBy("study_id", "period_idx", "class").agg(F.sum("score").alias("score"))


def repeated(periods: DataFrame, k: int) -> DataFrame:
    """Each label k times: study_id, sub_idx, stage."""
    return periods.select("study_id", F.explode(F.sequence(F.col("period_idx") * k, F.col("period_idx") * k + (k - 1))).alias("sub_idx"), "stage")


def ranked_by(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("nth") <= n)
