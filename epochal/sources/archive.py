"""Archives laid out by study: bucketed and sorted tables, over which windows, runs and joins by study need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY, ORDER = "study_id", ("study_id", "period_idx")


def write_by_study(rows: DataFrame, table: str, path: str, buckets: int) -> None:
    """rows as a table of so many buckets by study, each one file, sorted by study and period. Tables that are joined take the same
    number of buckets; a bucket should be about what a task can read, so buckets grow with the archive."""
    dealt = rows.repartition(buckets, KEY).sortWithinPartitions(*ORDER)
    dealt.write.bucketBy(buckets, KEY).sortBy(*ORDER).option("path", path).mode("overwrite").saveAsTable(table)


def attached(spark: SparkSession, table: str, path: str, buckets: int) -> DataFrame:
    """The table over files that another session has written; its catalogue entry is made if there is none."""
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({', '.join(ORDER)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two archives of equally many buckets by study and period. From now on the session's plans may meet two sides by a part of their
    keys: without that, equal buckets by study don't serve a join by study and period."""
    left.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return left.join(right.hint("merge"), list(ORDER))
