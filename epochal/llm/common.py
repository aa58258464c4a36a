"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.sources.shared import discard, materialize, new_path, scratch, shared_dir

__all__ = ["WORD", "discard", "exploded_copies", "kept", "materialize", "new_path", "row_hash", "salted_join", "scratch", "shared_dir", "small_batches", "spread", "table", "unused", "utf8_size"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that go to a Python worker at once.
BATCH = 2 << 20

_kept: dict[Hashable, Any] = {}  # in a worker: what it last built


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives, once in a worker until another key is asked for. Workers outlive jobs, so what the stages of a pipeline build
    would add up in them."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def small_batches(spark: SparkSession) -> None:
    """From now on texts go to Python workers in batches of about BATCH bytes. Spark counts up to 10,000 rows or 64 MB, which the
    executor and the worker each hold, for what they read and for what they write."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def exploded_copies(df: DataFrame, n: str, out: str, step: int = 8192) -> DataFrame:
    """One row for each of 0 .. n-1 in column out. In two levels, so no array is longer than n / step or step."""
    chunk = f"__{out}_chunk"
    return (
        df.withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {step}"))))
        .withColumn(out, F.explode(F.sequence(F.col(chunk) * step, F.least(F.col(n) - 1, F.col(chunk) * step + (step - 1)))))
        .drop(chunk)
    )


def spread(docs: DataFrame) -> DataFrame:
    """docs in at least as many partitions as there are cores, for work that costs more than moving the rows. Large tables have more
    and stay as they are; a small table may be one row group."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() >= cores:
        return docs
    return docs.repartition(cores, F.xxhash64("doc_id", "text"))


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def salted_join(rows: DataFrame, one: DataFrame, on: list[str], deal: str, how: str = "inner", salts: int = 32) -> DataFrame:
    """rows joined with a table of one row per key. The rows of a key are dealt over as many parts by a hash of the column deal, so
    none is joined in one task; only keys with many rows have many parts."""
    (salt,) = unused(rows, "salt")
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(deal), F.lit(salts)).cast("int"))
    parts = salted.select(*on, salt).distinct().join(one, on, how)
    return salted.join(parts, [*on, salt]).drop(salt)


def row_hash(docs: DataFrame, seed: int = 0) -> Column:
    """A hash of the text and all other columns, of whatever type."""
    others = [c for c in docs.columns if c != "text"]
    return F.xxhash64(F.lit(seed), "text", F.to_json(F.struct(*others)) if others else F.lit(""))
