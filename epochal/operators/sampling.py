"""Samplers: what a training loop draws, by seeded hash order, so draws repeat and scale with the number of studies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators.ordering import numbered_by_digest, running_by_number


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) for each combination of values: 48 bits of an MD5 digest, which any engine can compute."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def uniform_sql(seed: int, *parts: str) -> str:
    """The same as SQL."""
    values = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || left(md5(concat_ws('|', {values}, '{seed}')), 12) AS BIGINT) / {1 << 48}.0)"


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    u, v = (uniform(seed, *parts, F.lit(k)) for k in ("u", "v"))
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def normal_sql(seed: int, *parts: str) -> str:
    u, v = (uniform_sql(seed, *parts, f"'{k}'") for k in ("u", "v"))
    return f"(sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}))"


def random_periods(periods: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """draw, study_id, period_idx, n: a uniform study, then a uniform period of its n, with replacement. Draws are dealt to studies by
    equality of their running numbers."""
    sizes = running_by_number(periods.groupBy("study_id").agg(F.count("*").alias("n")), "nth", F.lit(1).cast("long"), "study_id")
    total = sizes.agg(F.max("nth_total")).first()[0] or 0
    drawn = periods.sparkSession.range(draws).select(F.col("id").alias("draw"), (F.floor(uniform(seed, F.col("id")) * total) + 1).alias("nth"))
    return drawn.join(sizes, "nth").select("draw", "study_id", F.floor(uniform(seed + 1, F.col("draw")) * F.col("n")).cast("int").alias("period_idx"), "n")


def balanced_periods(periods: DataFrame, per_class: int, seed: int = 0) -> DataFrame:
    """study_id, period_idx, stage: so many periods of every class that there is, without replacement, first by study and then
    within it, so that no study dominates a class."""
    within = Window.partitionBy("stage", "study_id").orderBy(uniform(seed, F.col("study_id"), F.col("period_idx")))
    turn = periods.withColumn("turn", F.row_number().over(within))
    over = Window.partitionBy("stage").orderBy("turn", uniform(seed + 1, F.col("study_id"), F.col("period_idx")))
    return turn.withColumn("nth", F.row_number().over(over)).filter(F.col("nth") <= per_class).select("study_id", "period_idx", "stage")


def batches(periods: DataFrame, size: int, random: bool = True, balanced: bool = True, seed: int = 0) -> DataFrame:
    """What a configuration's two settings ask for: so many periods of every class; so many uniform ones (draw, study_id, period_idx); or
    all periods in order, as batches of that size (batch, study_id, period_idx) that go on from one study to the next. Balanced ones that
    aren't random are an error."""
    if balanced and not random:
        raise ValueError("balanced batches are drawn at random, so random must be set")
    if balanced:
        return balanced_periods(periods, size, seed)
    if random:
        return random_periods(periods, size, seed).drop("n")
    sizes = running_by_number(periods.groupBy("study_id").agg(F.count("*").alias("n")), "until", F.col("n"), "study_id")
    place = F.col("until") - F.col("n") + F.col("period_idx")
    return periods.join(sizes, "study_id").select(F.floor(place / size).alias("batch"), "study_id", "period_idx")


def weighted_windows(periods: DataFrame, probabilities: DataFrame, classes: dict[int, float], draws: int, margin: int, seed: int = 0) -> DataFrame:
    """draw, dataset, class, study_id, center, offset, stage: for each draw a dataset by its probability, a class by its weight, one of
    the dataset's studies that have it, one of the study's periods of that class, all uniform and with replacement; a shift of up
    to margin periods, and the window of 2 margin + 1 periods around it, moved inward at a study's ends. Studies shorter than a window take
    no part; a class that no study of a drawn dataset has is an error. Studies are numbered within dataset and class, and periods
    within study and class, so draws meet them by equality. periods: dataset, study_id, period_idx, stage."""
    length, total = 2 * margin + 1, sum(classes.values())
    rows = periods.select("dataset", "study_id", "period_idx", "stage", F.count("*").over(Window.partitionBy("study_id")).alias("n")).filter(F.col("n") >= length)
    place = F.row_number().over(Window.partitionBy("study_id", "stage").orderBy("period_idx")) - 1
    rows = rows.withColumn("place", place)
    held = rows.groupBy("dataset", "stage", "study_id", "n").agg(F.count("*").alias("k"))
    held = numbered_by_digest(held, "nth", F.md5(F.concat_ws("|", F.col("study_id").cast("string"), F.lit(str(seed))).cast("binary")), "dataset", "stage")
    chosen, until = F.lit(max(classes)), 0.0
    u = uniform(seed + 1, F.col("draw"))
    for stage in sorted(classes, reverse=True):  # the innermost condition is that of the last class
        until = sum(w for c, w in classes.items() if c <= stage) / total
        chosen = F.when(u < until, F.lit(stage)).otherwise(chosen)
    drawn = mixed_batches(probabilities, draws, seed).withColumn("class", chosen)
    sizes = held.groupBy("dataset", F.col("stage").alias("class")).agg(F.max("nth_total").alias("studies"))
    drawn = drawn.join(sizes, ["dataset", "class"], "left")
    known = F.coalesce("studies", F.raise_error(F.concat(F.lit("no study of "), "dataset", F.lit(" has class "), F.col("class").cast("string"))).cast("long"))
    drawn = drawn.withColumn("nth", F.floor(uniform(seed + 2, F.col("draw")) * known) + 1)
    drawn = drawn.join(held.withColumnRenamed("stage", "class").select("dataset", "class", "nth", "study_id", "n", "k"), ["dataset", "class", "nth"])
    drawn = drawn.withColumn("place", F.floor(uniform(seed + 3, F.col("draw")) * F.col("k")).cast("int"))
    at = rows.select("study_id", F.col("stage").alias("class"), "place", "period_idx")
    drawn = drawn.join(at, ["study_id", "class", "place"])
    shift = F.floor(uniform(seed + 4, F.col("draw")) * length).cast("int") - margin
    center = F.col("period_idx") + shift
    begin = F.least(F.greatest(center - margin, F.lit(0)), (F.col("n") - length).cast("int"))
    wanted = drawn.select("draw", "dataset", "class", "study_id", center.alias("center"), F.posexplode(F.sequence(begin, begin + (length - 1))).alias("offset", "period_idx"))
    return wanted.join(periods.select("study_id", "period_idx", "stage"), ["study_id", "period_idx"]).drop("period_idx")


def mixed_batches(probabilities: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """draw, dataset: datasets by their probabilities, with replacement. Each dataset takes the cells of a fine grid that its
    share covers, and draws meet them by equality."""
    spark, cells = probabilities.sparkSession, 4096
    order = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, 0)
    cum = probabilities.withColumn("cum", F.sum("p").over(order)).withColumn("low", F.col("cum") - F.col("p"))
    grid = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("cum") * cells), F.lit(cells - 1).cast("long")))))
    drawn = spark.range(draws).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    last = F.max("cum").over(Window.partitionBy())
    hit = (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("cum")) | (F.col("cum") == F.col("top")))
    return drawn.join(grid.withColumn("top", last), "cell").filter(hit).select("draw", "dataset")


def validation_studies(studies: DataFrame, most: int, dataset: str = "dataset", key: str = "study_id") -> DataFrame:
    """The first studies of each dataset in order, at most so many."""
    return studies.withColumn("nth", F.row_number().over(Window.partitionBy(dataset).orderBy(key))).filter(F.col("nth") <= most).drop("nth")
