"""Losses and metrics by name, over rows of a true class and an array of class scores.

Those that are means over rows are computed together, in one aggregate that sums in the map tasks; dice takes sums per class, as one more.
Labels are numbers, so names say "sparse". A row whose true class isn't one of the scores' places is an error, or left out where
out-of-bounds classes are ignored. Rows with a null class or null scores don't count; a group without rows that count isn't in the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what keeps a logarithm finite.
EPSILON = 1e-7


def crossentropy(truth: Column, scores: Column) -> Column:
    return -F.log(F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.get(scores, truth))))


def focal(truth: Column, scores: Column, gamma: float = 2.0) -> Column:
    """Cross-entropy that counts less the surer it is."""
    return F.pow(1 - F.get(scores, truth), F.lit(float(gamma))) * crossentropy(truth, scores)


def accuracy(truth: Column, scores: Column) -> Column:
    """Of equal scores the first is the prediction."""
    return (F.array_position(scores, F.array_max(scores)) - 1 == truth).cast("double")


def top_k(truth: Column, scores: Column, k: int = 5) -> Column:
    """Whether fewer than k scores are higher."""
    own = F.get(scores, truth)
    return (F.size(F.filter(scores, lambda s: s > own)) < k).cast("double")


#: The names that configurations use.
ROWS: dict[str, Callable[..., Column]] = {
    "SparseCategoricalCrossentropy": crossentropy,
    "SparseCategoricalFocalLoss": focal,
    "SparseCategoricalAccuracy": accuracy,
    "SparseTopKCategoricalAccuracy": top_k,
}
DICE = "SparseDiceLoss"
REDUCTIONS = {"mean": F.avg, "sum": F.sum}


def register(name: str, measure: Callable[..., Column]) -> None:
    """Adds a measure of (truth, scores, settings); names are taken once."""
    if "sparse" not in name.lower():
        raise ValueError(f"{name}: labels are numbers, so names of losses and metrics say 'sparse'")
    if name in ROWS or name == DICE:
        raise ValueError(f"{name} is taken")
    ROWS[name] = measure


def checked(names: list[str]) -> None:
    for name in names:
        if "sparse" not in name.lower():
            raise ValueError(f"{name}: labels are numbers, so names of losses and metrics say 'sparse'")
        if name not in ROWS and name != DICE:
            raise ValueError(f"no loss or metric named {name}; there are {sorted([*ROWS, DICE])}")


def measured(rows: DataFrame, measures: dict[str, dict], by: list[str], reduction: str = "mean", ignore_out_of_bounds: bool = False) -> DataFrame:
    """by, name, value. measures: names with their settings; rows: by, truth, scores."""
    checked(list(measures))
    if reduction not in REDUCTIONS:
        raise ValueError(f"no reduction named {reduction}; there are {sorted(REDUCTIONS)}")
    truth, scores = F.col("truth"), F.col("scores")
    rows = rows.filter(truth.isNotNull() & scores.isNotNull()).select(*by, "truth", "scores")
    inside = (truth >= 0) & (truth < F.size(scores))
    if ignore_out_of_bounds:
        rows = rows.filter(inside)
    else:
        message = F.concat(F.lit("class "), truth.cast("string"), F.lit(" is out of bounds"))
        rows = rows.withColumn("truth", F.when(inside, truth).otherwise(F.raise_error(message).cast(rows.schema["truth"].dataType)))
    parts, flat = [], [n for n in measures if n != DICE]
    if flat:
        one = rows.groupBy(*by).agg(*(REDUCTIONS[reduction](ROWS[n](truth, scores, **measures[n])).alias(n) for n in flat))
        parts.append(one.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in flat)))))
    if DICE in measures:
        parts.append(dice(rows, by, **measures[DICE]).select(*by, F.lit(DICE).alias("name"), F.col("loss").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def dice(rows: DataFrame, by: list[str], smooth: float = 1.0) -> DataFrame:
    """by, loss: 1 - mean over classes of (2 sum(t y) + smooth) / (sum(t + y) + smooth), a group at a time."""
    each = rows.select(*by, "truth", F.posexplode("scores").alias("class", "y")).withColumn("t", (F.col("truth") == F.col("class")).cast("double"))
    per = each.groupBy(*by, "class").agg(F.sum(F.col("t") * F.col("y")).alias("ty"), F.sum(F.col("t") + F.col("y")).alias("both"))
    return per.groupBy(*by).agg((1 - F.avg((2 * F.col("ty") + smooth) / (F.col("both") + smooth))).alias("loss"))
