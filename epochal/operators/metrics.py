"""Evaluation: confusion matrices, ratios per class, agreement, and summaries.

Undefined values follow four rules: ratios of a confusion matrix are 0 where nothing is selected or relevant, per-study F1 is 1 for
a class that is absent from both sides, kappa is null there, and means skip nulls.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(otherwise))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def classes(df: DataFrame, k: int, name: str = "class") -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias(name))


def in_range(pairs: DataFrame, k: int) -> DataFrame:
    """Rows whose truth is one of the classes 0 to k - 1."""
    return pairs.filter(F.col("truth").between(0, k - 1))


def confusion(pairs: DataFrame, k: int, ignore: Iterable[int] = ()) -> DataFrame:
    """truth, pred, n for every pair of classes, zeros too. One shuffle of at most k * k rows per task."""
    kept = [c for c in range(k) if c not in set(ignore)]
    cells = pairs.sparkSession.range(k * k).select((F.col("id") / k).cast("int").alias("truth"), (F.col("id") % k).cast("int").alias("pred"))
    cells = cells.filter(F.col("truth").isin(kept) & F.col("pred").isin(kept))
    counts = pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return cells.join(counts, ["truth", "pred"], "left").fillna(0, ["n"])


def normalised(matrix: DataFrame) -> DataFrame:
    """Rows of the matrix sum to 1 (0 if the class is absent)."""
    return matrix.select("truth", "pred", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("truth"))).alias("share"))


def report(matrix: DataFrame) -> DataFrame:
    """class, precision, recall, f1; and their unweighted means as class mean."""
    cell = F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(0).alias("selected"), F.col("n").alias("relevant")), F.struct(F.col("pred").alias("class"), F.col("n").alias("selected"), F.lit(0).alias("relevant"))))
    rows = matrix.select(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), cell.alias("c")).select("hit", "c.*")
    per = rows.groupBy("class").agg(F.sum(F.col("hit") * F.when(F.col("relevant") > 0, 1).otherwise(0)).alias("tp"), F.sum("selected").alias("selected"), F.sum("relevant").alias("relevant"))
    per = per.select(F.col("class").cast("string").alias("class"), ratio(F.col("tp"), F.col("selected")).alias("precision"), ratio(F.col("tp"), F.col("relevant")).alias("recall"))
    per = per.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return per.unionByName(per.agg(F.lit("mean").alias("class"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))))


def accuracy(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("accuracy"))


def counters(pairs: DataFrame, *by: str) -> DataFrame:
    """by, class, tp, relevant, selected in one pass: each row counts once as truth and once as prediction."""
    hit = (F.col("truth") == F.col("pred")).cast("long")
    sides = F.inline(F.array(F.struct(F.col("truth").alias("class"), hit.alias("tp"), F.lit(1).cast("long").alias("relevant"), F.lit(0).cast("long").alias("selected")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("relevant"), F.lit(1).cast("long").alias("selected"))))
    return pairs.select(*by, sides).groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in ("tp", "relevant", "selected")))


def macro_micro_f1(pairs: DataFrame) -> DataFrame:
    """macro_f1 over the labels on either side, micro_f1 over all rows."""
    per = counters(pairs).withColumn("f1", ratio(2 * F.col("tp"), F.col("relevant") + F.col("selected")))
    return per.agg(F.avg("f1").alias("macro_f1"), ratio(2 * F.sum("tp"), F.sum("relevant") + F.sum("selected")).alias("micro_f1"))


def kappa(pairs: DataFrame, *by: str) -> DataFrame:
    """Cohen's kappa per group; null where chance agreement is complete."""
    per = counters(pairs, *by)
    sums = per.groupBy(*by).agg(F.sum("tp").cast("double").alias("tp"), F.sum("relevant").cast("double").alias("n"), F.sum(F.col("relevant").cast("double") * F.col("selected")).alias("cross"))
    po, pe = F.col("tp") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return sums.select(*by, F.try_divide(po - pe, 1 - pe).alias("kappa"))


def kappa_from(tp: Column, relevant: Column, selected: Column, n: Column) -> Column:
    """Of one class against the rest; null if the class is on neither side."""
    n = n.cast("double")
    po = (n - relevant - selected + 2 * tp) / n
    pe = (relevant.cast("double") * selected + (n - relevant) * (n - selected)) / (n * n)
    return F.when(relevant + selected > 0, F.try_divide(po - pe, 1 - pe))


def per_study(pairs: DataFrame, k: int) -> DataFrame:
    """study_id, class, tp, relevant, selected, n for each study and class 0 to k - 1."""
    totals = pairs.groupBy("study_id").agg(F.count("*").alias("n"))
    grid = totals.select("study_id", "n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("class"))
    return grid.join(counters(pairs, "study_id"), ["study_id", "class"], "left").fillna(0, ["tp", "relevant", "selected"])


def class_kappa(pairs: DataFrame, k: int) -> DataFrame:
    return per_study(pairs, k).select("study_id", "class", kappa_from(F.col("tp"), F.col("relevant"), F.col("selected"), F.col("n")).alias("kappa"))


def study_f1(pairs: DataFrame, k: int) -> DataFrame:
    """study_id, class, f1: 1 for a class on neither side; and the mean over classes as class -1."""
    per = per_study(pairs, k).select("study_id", "class", ratio(2 * F.col("tp"), F.col("relevant") + F.col("selected"), 1.0).alias("f1"))
    return per.unionByName(per.groupBy("study_id").agg(F.lit(-1).alias("class"), F.avg("f1").alias("f1")))


def grand_mean(per: DataFrame, value: str) -> DataFrame:
    """Mean over studies per class, the mean's row (class -1) among them."""
    return per.groupBy("class").agg(F.avg(value).alias(value))


def summary(per: DataFrame, value: str, drop: Iterable[str] = ()) -> DataFrame:
    """class, mean, std (of a sample), min, max over studies; without the studies named."""
    kept = per.filter(~F.col("study_id").cast("string").isin(list(drop))) if drop else per
    return kept.groupBy("class").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def class_counts(periods: DataFrame, *by: str) -> DataFrame:
    """by, stage, n and frequency; by rollup, so totals over all groups come along (null)."""
    counts = periods.rollup(*by, "stage").agg(F.count("*").alias("n"), F.grouping("stage").alias("total")).filter("total = 0")
    return counts.select(*by, "stage", "n", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*by))).alias("frequency"))


def dice_loss(scores: DataFrame, by: str) -> DataFrame:
    """1 - mean over classes of (2 sum(t y) + 1) / (sum(t + y) + 1) per group. scores: by, class, t, y."""
    per = scores.groupBy(by, "class").agg(F.sum(F.col("t") * F.col("y")).alias("ty"), F.sum(F.col("t") + F.col("y")).alias("both"))
    return per.groupBy(by).agg((1 - F.avg((2 * F.col("ty") + 1) / (F.col("both") + 1))).alias("loss"))


def sampling_probability(sizes: DataFrame, alpha: float = 0.5) -> DataFrame:
    """dataset, p: a mixture of sampling in proportion to size and evenly. sizes: dataset, n."""
    every = Window.partitionBy()
    return sizes.select("dataset", ((1 - alpha) * F.col("n") / F.sum("n").over(every) + alpha / F.count("*").over(every)).alias("p"))
