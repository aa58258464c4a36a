"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, tokens. Counted as part of the llm subpackage.

Each stage is written to the shared folder and read again by the next; what a stage wrote on its way, and what the stage before
it gave, is deleted once it is done.

Defined cases: null and empty texts are in no language and go in the first stage, as do texts without a letter; texts of any length
go through whole; of rows that are equal, or whose texts are near-duplicates, one stays, the one with the least doc_id; a null doc_id or
source is kept as it is, and a null lang becomes the predicted one; columns beside those of documents stay, whatever their
names, up to the last stage, which returns its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import bpe, langid, mixing, secrets, simhash
from epochal.llm.common import discard, new_path, scratch, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in no language go."""
    small_batches(spark)
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, the one with the smallest id."""
    small_batches(spark)
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked; no document goes."""
    small_batches(spark)
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go as the sources' target weights ask."""
    return mixing.resampled(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and decoded_sha256: the digest of the text that the ids decode to."""
    import public_tokenizers

    small_batches(spark)
    encoded = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing", mix),
    ("BPE", tokenize),
]
ORACLE_SQL = None  # no stage but mixing and secrets comes near to SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES[:-1]:
        before, path = docs, new_path(spark, name.lower().replace(" ", "-"))
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if written:
            discard(before)
        written = True
    return STAGES[-1][1](spark, docs, sf_dir)
