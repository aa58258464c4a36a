"""Windows and batches over a study's periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators.ordering import permuted, running_by_number


def sized(periods: DataFrame) -> DataFrame:
    return periods.withColumn("n", F.count("*").over(Window.partitionBy("study_id")))


def margin_windows(periods: DataFrame, m: int, *carry: str) -> DataFrame:
    """study_id, center, offset and the carried columns: 2m + 1 periods around each, shifted inward at the borders. Studies shorter
    than a window give none. Centres unfold into the places that they need, so the join is on equality."""
    length = 2 * m + 1
    start = F.least(F.greatest(F.col("period_idx") - m, F.lit(0)), (F.col("n") - length).cast("int"))
    centres = sized(periods.select("study_id", "period_idx")).filter(F.col("n") >= length)
    wanted = centres.select("study_id", F.col("period_idx").alias("center"), F.posexplode(F.sequence(start, start + (length - 1))).alias("offset", "period_idx"))
    return wanted.join(periods.select("study_id", "period_idx", *carry), ["study_id", "period_idx"]).select("study_id", "center", "offset", *carry)


def sliding(periods: DataFrame, length: int, value: str) -> DataFrame:
    """study_id, start, values: every window of that length, one period apart."""
    frame = Window.partitionBy("study_id").orderBy("period_idx").rowsBetween(0, length - 1)
    return periods.select("study_id", F.col("period_idx").alias("start"), F.collect_list(value).over(frame).alias("values")).filter(F.size("values") == length)


def chunks(periods: DataFrame, length: int) -> DataFrame:
    """periods with chunk and place; the rest of n mod length periods at a study's end goes."""
    rows = sized(periods).filter(F.col("period_idx") < F.col("n") - F.col("n") % length).drop("n")
    return rows.withColumn("chunk", F.expr(f"cast(period_idx div {length} as int)")).withColumn("place", F.col("period_idx") % length)


def batches(periods: DataFrame, size: int) -> DataFrame:
    """study_id, batch, n: batches of that size within studies, the last one shorter."""
    return periods.groupBy("study_id", F.expr(f"cast(period_idx div {size} as int)").alias("batch")).agg(F.count("*").alias("n"))


def study_sizes(periods: DataFrame) -> DataFrame:
    return periods.groupBy("study_id").agg(F.count("*").alias("n"))


def cumulative(sizes: DataFrame, margin: int = 0) -> DataFrame:
    """study_id, n, usable, cum: windows of each study and their running sum in study order. One row per study."""
    usable = sizes.withColumn("usable", F.greatest(F.col("n") - 2 * margin, F.lit(0)))
    return running_by_number(usable, "cum", F.col("usable").cast("bigint"), "study_id").drop("cum_total")


def located(sizes: DataFrame, batch: int, margin: int) -> DataFrame:
    """batch, study_id, center: which study and centre each batch of the global order begins with. Every study unfolds into the
    batches that begin in it, instead of a range join."""
    places = cumulative(sizes, margin).filter("usable > 0").withColumn("before", F.col("cum") - F.col("usable"))
    first, last = F.ceil(F.col("before") / batch), F.expr(f"(cum - 1) div {batch}")
    rows = places.filter(first <= last).withColumn("batch", F.explode(F.sequence(first, last)))
    return rows.select("batch", "study_id", (F.col("batch") * batch - F.col("before") + margin).alias("center"))


def epoch_order(sizes: DataFrame, margin: int, key: str, readers: int, reader: int | None = None) -> DataFrame:
    """reader, place, study_id, center: every window of an epoch once, shuffled by the key, in a contiguous run of places for each reader.
    A place is taken to a window by a keyed bijection, and a window to its study by sums of the studies' windows, met in cells
    of about a study's length. So nothing is sorted, and a reader's slice (reader) is made without those of the others."""
    spark, cum = sizes.sparkSession, cumulative(sizes, margin).filter("usable > 0")
    total, studies = cum.agg(F.coalesce(F.sum("usable"), F.lit(0)), F.count("*")).first()
    cell = max(1, total // max(1, studies))
    first = lambda r: -(-r * total // readers)
    low, high = (0, total) if reader is None else (first(reader), first(reader + 1))
    places = spark.range(low, high).select(F.col("id").alias("place"), F.expr(f"cast(id * {readers} div {max(total, 1)} as int)").alias("reader"))
    places = places.withColumn("w", permuted(F.col("place"), max(total, 1), key)).withColumn("cell", F.expr(f"w div {cell}"))
    begins = cum.withColumn("before", F.col("cum") - F.col("usable"))
    begins = begins.withColumn("cell", F.explode(F.sequence(F.expr(f"before div {cell}"), F.expr(f"(cum - 1) div {cell}"))))
    met = places.join(begins, "cell").filter((F.col("w") >= F.col("before")) & (F.col("w") < F.col("cum")))
    return met.select("reader", "place", "study_id", (F.col("w") - F.col("before") + margin).alias("center"))
