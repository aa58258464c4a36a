"""Records filtered and resampled in blocks: a study is 64 embeddings, each a block of four channels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.operators import blocks
from epochal.operators.signals import band_pass_taps
from epochal.plans.registry import query
from epochal.sources import tables as t

KEY, LENGTH = ("study_id", "channel"), t.SAMPLES
BAND, NOTCH, UP, DOWN, ZEROS = (128.0, 4.0, 30.0, 41), (128.0, 50.0, 5.0), 5, 8, 4
RECORDS = f"""{t.SAMPLES_SQL}, numbered AS (SELECT vec_id, CAST(vec_id // 64 AS BIGINT) AS study_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS p FROM embeddings),
records AS (SELECT study_id, channel, p * {LENGTH} + idx AS i, x FROM samples JOIN numbered USING (vec_id))"""


def records(spark, sf_dir):
    """study_id, channel, period_idx, samples."""
    nth = F.row_number().over(Window.partitionBy("study_id").orderBy("vec_id")) - 1
    e = t.table(spark, sf_dir, "embeddings").withColumn("study_id", F.expr("vec_id div 64")).select("study_id", nth.alias("period_idx"), "embedding")
    four = F.transform(F.sequence(F.lit(0), F.lit(t.CHANNELS - 1)), lambda c: F.struct(c.alias("channel"), F.slice("embedding", c * LENGTH + 1, LENGTH).alias("samples")))
    return e.select("study_id", "period_idx", F.inline(four))


def long_form(made):
    return made.select(*KEY, "period_idx", F.posexplode("samples").alias("idx", "x")).withColumn("x", F.round("x", 5) + 0.0)


def listed(values):
    return f"[{', '.join(map(repr, values))}]::DOUBLE[]"


@query(f"""WITH {RECORDS}, taps AS (SELECT unnest(range({BAND[3]})) - {BAND[3] // 2} AS d, unnest({listed(band_pass_taps(*BAND))}) AS w),
y AS (SELECT r.study_id, r.channel, r.i + d AS i, sum(w * x) AS y FROM records r, taps GROUP BY ALL)
SELECT study_id, channel, CAST(i // {LENGTH} AS INTEGER) AS period_idx, CAST(i % {LENGTH} AS INTEGER) AS idx, round(y, 5) + 0.0 AS x FROM y SEMI JOIN records USING (study_id, channel, i)""")
def band_pass(spark, sf_dir):
    return long_form(blocks.band_pass(records(spark, sf_dir), *BAND, LENGTH, *KEY))


_b, _a = blocks.notch_coefficients(*NOTCH)


@query(f"""WITH RECURSIVE {RECORDS}, u AS MATERIALIZED (SELECT study_id, channel, i, {_b[0]!r} * x + {_b[1]!r} * coalesce(lag(x) OVER w, 0) + {_b[2]!r} * coalesce(lag(x, 2) OVER w, 0) AS u FROM records WINDOW w AS (PARTITION BY study_id, channel ORDER BY i)),
y AS (SELECT study_id, channel, i, u AS y, CAST(0 AS DOUBLE) AS y1 FROM u WHERE i = 0
UNION ALL SELECT u.study_id, u.channel, u.i, u.u - ({_a[0]!r}) * y.y - ({_a[1]!r}) * y.y1, y.y FROM y JOIN u ON u.study_id = y.study_id AND u.channel = y.channel AND u.i = y.i + 1)
SELECT study_id, channel, CAST(i // {LENGTH} AS INTEGER) AS period_idx, CAST(i % {LENGTH} AS INTEGER) AS idx, round(y, 5) + 0.0 AS x FROM y""")
def notch(spark, sf_dir):
    return long_form(blocks.notch(records(spark, sf_dir), *NOTCH, LENGTH, *KEY))


_half = ZEROS * max(UP, DOWN)


@query(f"""WITH {RECORDS}, sized AS (SELECT study_id, channel, count(*) AS n FROM records GROUP BY 1, 2), taps AS (SELECT unnest(range(-{_half}, {_half} + 1)) AS d, unnest({listed(blocks.resampling_taps(UP, DOWN, ZEROS))}) AS w),
y AS (SELECT study_id, channel, (i * {UP} + d) // {DOWN} AS m, sum(w * x) AS y FROM records, taps WHERE i * {UP} + d >= 0 AND (i * {UP} + d) % {DOWN} = 0 GROUP BY ALL)
SELECT study_id, channel, CAST(m // {LENGTH * UP // DOWN} AS INTEGER) AS period_idx, CAST(m % {LENGTH * UP // DOWN} AS INTEGER) AS idx, round(y, 5) + 0.0 AS x FROM y JOIN sized USING (study_id, channel) WHERE m * {DOWN} < n * {UP}""")
def resample_rational(spark, sf_dir):
    return long_form(blocks.resampled(records(spark, sf_dir), UP, DOWN, LENGTH, *KEY, zeros=ZEROS))
