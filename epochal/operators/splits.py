"""Leakage-free splits: the unit is the subject, and records follow it. Order is by a seeded hash, never by files or by chance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators.ordering import numbered_by_digest


def shuffled_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def sizes(n: int, test: float, val: float, most_test: int | None = None, most_val: int | None = None) -> tuple[int, int, int]:
    """Numbers of train, validation and test subjects. Fractions round up and may be capped; nothing left to train on is an error."""
    n_test = min(math.ceil(n * test), most_test if most_test is not None else n)
    n_val = min(math.ceil(n * val), most_val if most_val is not None else n)
    if n - n_test - n_val <= 0:
        raise ValueError(f"{n} subjects leave none to train on after {n_test} for test and {n_val} for validation")
    return n - n_test - n_val, n_val, n_test


def assigned(subjects: DataFrame, key: str, test: float, val: float, seed: int = 0) -> DataFrame:
    """subjects with a column split. One row per subject is ordered; records join it afterwards."""
    rows = numbered_by_digest(subjects, "nth", shuffled_key(key, seed))
    n_test, n_val = F.ceil(F.col("nth_total") * test), F.ceil(F.col("nth_total") * val)
    split = F.when(F.col("nth") <= n_test, "test").when(F.col("nth") <= n_test + n_val, "val").otherwise("train")
    return rows.withColumn("split", split).drop("nth", "nth_total")


def folds(subjects: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """subjects with a column fold from 0; the first n mod k folds have one more."""
    rows = numbered_by_digest(subjects, "nth", shuffled_key(key, seed))
    larger = F.expr(f"(nth_total % {k}) * (nth_total div {k} + 1)")
    fold = F.when(F.col("nth") <= larger, F.expr(f"(nth - 1) div (nth_total div {k} + 1)")).otherwise(F.expr(f"nth_total % {k}") + F.floor((F.col("nth") - 1 - larger) / F.expr(f"nth_total div {k}")))
    return rows.withColumn("fold", fold.cast("int")).drop("nth", "nth_total")


def followed(records: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    return records.join(subjects, key)


def split_counts(records: DataFrame, subject: str) -> DataFrame:
    """split, records, subjects, and their totals as split total."""
    counts = records.groupBy("split").agg(F.count("*").alias("records"), F.countDistinct(subject).alias("subjects"))
    return counts.unionByName(counts.agg(F.lit("total").alias("split"), F.sum("records").alias("records"), F.sum("subjects").alias("subjects")))


def name_group(name: str, pattern: str) -> Column:
    """The one capture of a pattern in a name; none or several matches are an error."""
    found = F.regexp_extract_all(name, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) == 1, found[0]).otherwise(F.raise_error(F.concat(F.lit("not exactly one match in "), F.col(name))).cast("string"))


def grouped_names(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """group, names."""
    return df.groupBy(name_group(name, pattern).alias("group")).agg(F.array_sort(F.collect_list(name)).alias("names"))


def channel_combinations(groups: list[list[str]]) -> list[list[str]]:
    """The product of channel groups in order, without those whose set of channels came before. A handful of names, no data."""
    out, seen = [[]], set()
    for group in groups:
        out = [[*chosen, c] for chosen in out for c in group]
    return [c for c in out if not (frozenset(c) in seen or seen.add(frozenset(c)))]


def n_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, in seeded order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(shuffled_key(key, seed)))).filter(F.col("nth") <= n).drop("nth")
