"""The data model over the driver's tables, and the same as SQL.

A study is a user of `events`, a period one of its events in time order, the stage its event type. Voters are three deterministic
predictors. All arithmetic is on integers, so another engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event types in the order of their stages.
STAGES = ("view", "click", "purchase", "signup", "error")
STAGE_NAMES = ("W", "N1", "N2", "N3", "REM")
VOTERS = (1, 2, 3)
CHANNELS, SAMPLES = 4, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_map(column: str, labels: dict) -> F.Column:
    """Many raw labels to few classes; raw labels that aren't named give null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.col(column))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id, period_idx, ts, event_id, value, stage."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("study_id"), (F.row_number().over(order) - 1).alias("period_idx"), "ts", "event_id", "value",
        label_map("event_type", {k: i for i, k in enumerate(STAGES)}).alias("stage"),
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id, period_idx, truth, voter, pred."""
    numbered = periods(spark, sf_dir).withColumn("voter", F.explode(F.array(*map(F.lit, VOTERS))))
    right = F.pmod(F.col("event_id") * (2 * F.col("voter") + 1) + F.floor("value"), F.lit(7)) < 4
    pred = F.when(right, F.col("stage")).otherwise((F.col("stage") + F.col("voter")) % 5)
    return numbered.select("study_id", "period_idx", F.col("stage").alias("truth"), "voter", pred.alias("pred"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id, period_idx, truth, pred: those of the first voter."""
    return votes(spark, sf_dir).filter("voter = 1").drop("voter")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, channel, scores: an embedding as four channels of sixteen samples."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(CHANNELS - 1)), lambda k: F.struct(k.alias("channel"), F.slice(F.col("embedding").cast("array<double>"), k * SAMPLES + 1, SAMPLES).alias("scores")))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.inline(cut))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, channel, idx, x: one row per sample."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x"))
    return rows.select("vec_id", F.expr(f"cast(at div {SAMPLES} as int)").alias("channel"), (F.col("at") % SAMPLES).alias("idx"), "x")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study_id, init_sec, duration_sec, stage: every run of stages, at 30 seconds a period."""
    from epochal.operators import labels

    return labels.run_lengths(periods(spark, sf_dir), 30)


PERIODS = """periods AS (SELECT user_id AS study_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS period_idx, ts, event_id, value,
CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS INTEGER) AS stage FROM events)"""
VOTES = (
    PERIODS
    + """, votes AS (SELECT study_id, period_idx, stage AS truth, CAST(k AS INTEGER) AS voter,
CAST(CASE WHEN (((event_id * (2 * k + 1) + CAST(floor(value) AS BIGINT)) % 7) + 7) % 7 < 4 THEN stage ELSE (stage + k) % 5 END AS INTEGER) AS pred FROM periods, (VALUES (1), (2), (3)) v(k))"""
)
PAIRS = VOTES + ", pairs AS (SELECT study_id, period_idx, truth, pred FROM votes WHERE voter = 1)"
SAMPLES_SQL = "samples AS (SELECT vec_id, CAST(i // 16 AS INTEGER) AS channel, CAST(i % 16 AS INTEGER) AS idx, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS i))"
SPARSE = (
    PERIODS
    + """, flagged AS (SELECT *, CASE WHEN stage = lag(stage) OVER (PARTITION BY study_id ORDER BY period_idx) THEN 0 ELSE 1 END AS turn FROM periods),
numbered AS (SELECT *, sum(turn) OVER (PARTITION BY study_id ORDER BY period_idx) AS run FROM flagged),
sparse AS (SELECT study_id, CAST(min(period_idx) * 30 AS INTEGER) AS init_sec, CAST(count(*) * 30 AS INTEGER) AS duration_sec, stage FROM numbered GROUP BY study_id, run, stage)"""
)
