"""What surrounds training: logs, checkpoints, budgets and receptive fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics in the order in which they decide which model is best, and whether more is better.
BEST_BY = (("val_dice", True), ("val_loss", False), ("dice", True), ("loss", False))


def last_run(log: DataFrame) -> DataFrame:
    """The rows from the last one that has epoch 0. log: rn (order), epoch, ..."""
    begin = log.agg(F.max(F.when(F.col("epoch") == 0, F.col("rn"))).alias("begin"))  # one row
    return log.join(F.broadcast(begin), F.col("rn") >= F.col("begin")).drop("begin")


def rate_at(log: DataFrame, epoch: int) -> DataFrame:
    """learning_rate at that epoch of the last run, and at its last epoch."""
    return last_run(log).agg(F.max(F.when(F.col("epoch") == epoch, F.col("learning_rate"))).alias("at_epoch"), F.max_by("learning_rate", "rn").alias("latest"))


def best_model(files: DataFrame) -> DataFrame:
    """file: the best by the first metric that any file name has; of equally good ones that of the earliest epoch, then the first by
    name. files: file, named like `@epoch_7_val_dice_0.81.h5`."""
    picks, epoch = [], F.expr("try_cast(nullif(regexp_extract(file, 'epoch_([0-9]+)', 1), '') as bigint)")
    for metric, more in BEST_BY:
        score = F.expr(f"try_cast(nullif(regexp_extract(file, '(?:^|_){metric}_([0-9]+[.][0-9]+)', 1), '') as double)")
        plain = F.lit(True) if metric.startswith("val") else ~F.col("file").contains(f"val_{metric}")
        score = F.when(plain, score)
        picks.append(F.min(F.when(score.isNotNull(), F.struct((-score if more else score).alias("score"), epoch.alias("epoch"), "file")))["file"])
    return files.agg(F.coalesce(*picks).alias("file"))


def last_model(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("file", F.expr("cast(nullif(regexp_extract(file, 'epoch_([0-9]+)', 1), '') as int)")).alias("file"))


def steps(total: Column, most: int, margin: int, batch: int) -> Column:
    """Batches in an epoch: of the samples there are, at most so many, as windows of 2 margin + 1."""
    samples = F.least(total, F.lit(most))
    if margin > 0:
        samples = F.floor(samples / (2 * margin + 1))
    return F.ceil(samples / batch).cast("long")


def receptive_field(layers: Column) -> Column:
    """Samples that one output sees. layers: array of kernel, stride, dilation."""
    start = F.struct(F.lit(1).cast("long").alias("field"), F.lit(1).cast("long").alias("jump"))
    seen = F.aggregate(layers, start, lambda acc, x: F.struct((acc["field"] + (x["kernel"] - 1) * x["dilation"] * acc["jump"]).cast("long").alias("field"), (acc["jump"] * x["stride"]).cast("long").alias("jump")))
    return seen["field"]
