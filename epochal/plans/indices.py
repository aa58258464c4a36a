"""Queries for class indices as bitmaps."""

from pyspark.sql import functions as F

from epochal.operators import bitmaps
from epochal.plans.registry import query
from epochal.sources import tables as t


@query(f"""WITH {t.PERIODS}, b AS (SELECT study_id, stage, period_idx // 32768 AS bucket, period_idx % 32768 // 8 AS byte, sum(1 << (period_idx % 8)) AS v FROM periods GROUP BY ALL),
w AS (SELECT study_id, stage, bucket, unnest(range(max(byte) + 1)) AS byte FROM b GROUP BY 1, 2, 3), c AS (SELECT study_id, stage, period_idx // 32768 AS bucket, count(*) AS n FROM periods GROUP BY 1, 2, 3),
h AS (SELECT w.study_id, w.stage, w.bucket, string_agg(printf('%02X', CAST(coalesce(v, 0) AS INTEGER)), '' ORDER BY w.byte) AS bits
FROM w LEFT JOIN b ON b.study_id = w.study_id AND b.stage = w.stage AND b.bucket = w.bucket AND b.byte = w.byte GROUP BY 1, 2, 3)
SELECT h.study_id, h.stage, CAST(h.bucket AS BIGINT) AS bucket, bits, n FROM h JOIN c ON c.study_id = h.study_id AND c.stage = h.stage AND c.bucket = h.bucket""")
def class_bitmaps(spark, sf_dir):
    """Where each class of a study is, as hexadecimal bytes, the first period in the lowest bit of the first."""
    return bitmaps.class_bitmaps(t.periods(spark, sf_dir)).withColumn("bits", F.hex("bits"))


@query(f"WITH {t.PERIODS} SELECT study_id FROM periods WHERE stage IN (0, 2, 4) GROUP BY 1 HAVING count(DISTINCT stage) = 3")
def studies_with_classes(spark, sf_dir):
    """Studies that have a given set of classes, by bitmaps of studies that are met byte by byte."""
    labels = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("study_id"), t.label_map("event_type", {k: i for i, k in enumerate(t.STAGES)}).alias("stage"))
    return bitmaps.having(bitmaps.studies_by_class(labels), [0, 2, 4])
