"""Class indices as bitmaps: where a class is, one bit a period, and which studies have it, one bit a study.

A bitmap covers BITS numbers, one bucket; a bit costs an eighth of a byte where a list of numbers costs four. Partial bitmaps are merged in the
map tasks, so hot studies and classes meet as bitmaps, never as rows, and no group holds more than one bitmap. Numbers are not negative.
Nulls are in no bitmap, repeated rows count once, and an empty table gives an empty index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the numbers that a bitmap of Spark's covers.
BITS = 32_768


def bucketed(number: Column) -> tuple[Column, Column]:
    """The bucket of a number, and its place in the bucket's bitmap."""
    return F.bitmap_bucket_number(number.cast("long") + 1) - 1, F.bitmap_bit_position(number.cast("long") + 1)


def built(rows: DataFrame, number: str, *keys: str) -> DataFrame:
    """keys, bucket, bits, n: the numbers of each key, in as many bytes as the last of them needs."""
    bucket, place = bucketed(F.col(number))
    marked = rows.filter(F.col(number).isNotNull()).select(*keys, bucket.alias("bucket"), place.alias("place"))
    made = marked.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("place").alias("bits"), F.max("place").alias("last"))
    bits = F.substring(F.col("bits"), F.lit(1), F.expr("cast(last div 8 + 1 as int)"))
    return made.select(*keys, "bucket", bits.alias("bits"), F.bitmap_count("bits").alias("n"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Of several indices under one another (a day's and another's, say), one, without reading the periods again."""
    whole = F.rpad(F.col("bits"), F.lit(BITS // 8), F.lit(b"\0"))
    made = parts.groupBy(*keys, "bucket").agg(F.bitmap_or_agg(whole).alias("bits"), F.max(F.length("bits")).alias("size"))
    return made.select(*keys, "bucket", F.substring(F.col("bits"), F.lit(1), F.col("size").cast("int")).alias("bits"), F.bitmap_count("bits").alias("n"))


def numbers(bits: Column, bucket: Column) -> Column:
    """The numbers of a bitmap, ascending."""

    def of(i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, i + 1, F.lit(1))), 16, 10).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(byte, b) == 1), lambda b: bucket * BITS + i * 8 + b)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(bits) - 1), of))


def class_bitmaps(periods: DataFrame) -> DataFrame:
    """study_id, stage, bucket, bits, n: where in a study each class is."""
    return built(periods, "period_idx", "study_id", "stage")


def studies_by_class(periods: DataFrame) -> DataFrame:
    """stage, bucket, bits, n: which studies (whole numbers) have each class."""
    return built(periods, "study_id", "stage")


def having(index: DataFrame, classes: list[int]) -> DataFrame:
    """study_id: the studies that have all of the classes, from studies_by_class alone. A bucket in which a class is missing has none."""
    asked = index.filter(F.col("stage").isin(classes))
    bits = F.rpad(F.col("bits"), F.lit(BITS // 8), F.lit(b"\0"))
    both = asked.groupBy("bucket").agg(F.count("*").alias("found"), F.bitmap_and_agg(bits).alias("bits")).filter(F.col("found") == len(set(classes)))
    return both.select(F.explode(numbers(F.col("bits"), F.col("bucket"))).alias("study_id"))
