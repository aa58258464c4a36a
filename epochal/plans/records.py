"""Signals as files: written by one job, read in ranges by another."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.plans.registry import query
from epochal.sources import records
from epochal.sources import tables as t
from epochal.sources.shared import new_path

#: What is stored for a sample x from -4 to 4, and what is read for it.
STORED = "least(greatest(floor((x + 4.0) * (65535 / 8.0) - 32768 + 0.5), -32768), 32767)"
READ = f"round(CAST(CAST(({STORED} + 32768) * (8.0 / 65535) - 4.0 AS FLOAT) AS DOUBLE), 6)"


def written(spark, sf_dir):
    """A folder with an EDF file for each 64 embeddings: an embedding is a period of four channels."""
    e = t.table(spark, sf_dir, "embeddings").withColumn("study_id", F.expr("vec_id div 64"))
    nth = F.row_number().over(Window.partitionBy("study_id").orderBy("vec_id")) - 1
    four = F.inline(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.struct(F.concat(F.lit("C"), c.cast("string")).alias("channel"), F.slice("embedding", c * 16 + 1, 16).alias("samples"))))
    periods = e.select("study_id", nth.alias("period_idx"), "embedding").select("study_id", "period_idx", four)
    names = periods.select("study_id", "channel").distinct()
    folder = new_path(spark, "edf")
    records.write_edf(periods, folder, names.select("*", F.lit("uV").alias("unit"), F.lit(-4.0).alias("phys_min"), F.lit(4.0).alias("phys_max"), F.concat(F.lit("study "), "study_id").alias("patient")), 2)
    return folder


@query(f"""WITH {t.SAMPLES_SQL}, numbered AS (SELECT vec_id, CAST(vec_id // 64 AS VARCHAR) AS study_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS period_idx FROM embeddings)
SELECT study_id, concat('C', channel) AS channel, CAST(period_idx AS BIGINT) AS period_idx, CAST(8 AS DOUBLE) AS sample_rate, idx, {READ} AS x FROM samples JOIN numbered USING (vec_id)""")
def edf_round_trip(spark, sf_dir):
    """Samples as they come back from EDF files, in ranges of 64 KB."""
    rows = records.read_periods(spark, written(spark, sf_dir), 2, 1 << 16)
    long = rows.select("study_id", "channel", "period_idx", "sample_rate", F.posexplode("samples").alias("idx", "x"))
    return long.withColumn("x", F.round(F.col("x").cast("double"), 6))


@query("""WITH sized AS (SELECT vec_id // 64 AS study_id, count(*) AS n FROM embeddings GROUP BY 1)
SELECT CAST(study_id AS VARCHAR) AS study_id, concat('C', c) AS channel, CAST(8 AS DOUBLE) AS sample_rate, CAST(n * 16 AS BIGINT) AS n_samples, 'uV' AS unit, CAST(-4 AS DOUBLE) AS phys_min, concat('study ', study_id) AS patient
FROM sized, (SELECT unnest(range(4)) AS c)""")
def edf_headers(spark, sf_dir):
    """Headers of the same files; no signal is read."""
    return records.read_headers(spark, written(spark, sf_dir)).select("study_id", "channel", "sample_rate", "n_samples", "unit", "phys_min", "patient")
