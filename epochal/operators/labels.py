"""Label preparation: runs, intervals, trims and masks. Every operator works within studies, so all shuffles are by study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_study() -> Window:
    return Window.partitionBy("study_id")


def run_lengths(periods: DataFrame, seconds: int) -> DataFrame:
    """Dense to sparse: study_id, init_sec, duration_sec, stage."""
    order = by_study().orderBy("period_idx")
    turn = F.when(F.col("stage").eqNullSafe(F.lag("stage").over(order)) & (F.lag("period_idx").over(order) == F.col("period_idx") - 1), 0).otherwise(1)
    runs = periods.withColumn("turn", turn).withColumn("run", F.sum("turn").over(order))
    return runs.groupBy("study_id", "run", "stage").agg((F.min("period_idx") * seconds).cast("int").alias("init_sec"), (F.count("*") * seconds).cast("int").alias("duration_sec")).select("study_id", "init_sec", "duration_sec", "stage")


def densified(sparse: DataFrame, seconds: int) -> DataFrame:
    """Sparse to dense: study_id, period_idx, stage. Intervals unfold into periods, so no range join is needed."""
    last = F.expr(f"(init_sec + duration_sec - 1) div {seconds}")
    return sparse.select("study_id", F.explode(F.sequence(F.expr(f"cast(init_sec div {seconds} as int)"), last.cast("int"))).alias("period_idx"), "stage")


def without_offset(sparse: DataFrame) -> DataFrame:
    """The first interval of a study begins at 0."""
    return sparse.withColumn("init_sec", (F.col("init_sec") - F.min("init_sec").over(by_study())).cast("int"))


def with_least_duration(sparse: DataFrame, seconds: int) -> DataFrame:
    """Intervals without duration last so many seconds."""
    return sparse.withColumn("duration_sec", F.when(F.col("duration_sec") == 0, seconds).otherwise(F.col("duration_sec")))


def with_gaps(sparse: DataFrame, label: int) -> DataFrame:
    """Intervals of the given label where a study has none. Overlaps are an error."""
    following = F.lead("init_sec").over(by_study().orderBy("init_sec"))
    ends = sparse.withColumn("end", F.col("init_sec") + F.col("duration_sec")).withColumn("next", following)
    ends = ends.withColumn("next", F.when(F.col("next") < F.col("end"), F.raise_error(F.lit("intervals overlap"))).otherwise(F.col("next")).cast("int"))
    gaps = ends.filter("next > end").select("study_id", F.col("end").cast("int").alias("init_sec"), (F.col("next") - F.col("end")).cast("int").alias("duration_sec"), F.lit(label).alias("stage"))
    return sparse.unionByName(gaps)


def grouped(stage: Column, members: tuple[int, ...], into: int) -> Column:
    return F.when(stage.isin(*members), F.lit(into)).otherwise(stage)


def wake_trimmed(periods: DataFrame, around: int, wake: int = 0, stage: str = "stage") -> DataFrame:
    """Periods from `around` before a study's first stage other than wake until `around` after its last, the end exclusive. A
    study that is all wake goes."""
    awake = F.when(F.col(stage) != wake, F.col("period_idx"))
    ends = periods.withColumn("first", F.min(awake).over(by_study())).withColumn("last", F.max(awake).over(by_study()))
    return ends.filter((F.col("period_idx") >= F.greatest(F.lit(0), F.col("first") - around)) & (F.col("period_idx") < F.col("last") + around)).drop("first", "last")


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Periods that both have: trims both to their common length and joins by key."""
    return left.join(right, ["study_id", "period_idx"])


def smoothed(periods: DataFrame, kernel: tuple[float, ...], k: int) -> DataFrame:
    """study_id, period_idx, class, weight: one-hot labels convolved along each study, mirrored at its ends (-1-j is j)."""
    half = len(kernel) // 2
    sized = periods.withColumn("n", F.count("*").over(by_study()))
    taps = F.explode(F.array(*(F.struct(F.lit(half - i).alias("by"), F.lit(w).alias("w")) for i, w in enumerate(kernel)))).alias("tap")
    shifted = sized.select("study_id", "period_idx", "n", taps).select("study_id", "period_idx", "n", (F.col("period_idx") - F.col("tap.by")).alias("at"), F.col("tap.w").alias("w"))
    mirrored = F.when(F.col("at") < 0, -1 - F.col("at")).when(F.col("at") >= F.col("n"), 2 * F.col("n") - 1 - F.col("at")).otherwise(F.col("at")).cast("int")
    near = shifted.select("study_id", "period_idx", mirrored.alias("at"), "w")
    labels = periods.select("study_id", F.col("period_idx").alias("at"), F.col("stage").alias("class"))
    return near.join(labels, ["study_id", "at"]).filter(F.col("class") < k).groupBy("study_id", "period_idx", "class").agg(F.sum("w").alias("weight"))


def class_index(periods: DataFrame) -> DataFrame:
    """study_id, stage, indices: where in a study each class is, ascending."""
    return periods.groupBy("study_id", "stage").agg(F.array_sort(F.collect_list("period_idx")).alias("indices"))
