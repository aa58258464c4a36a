"""Queries for the preparation of labels and signals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.operators import labels, metrics, signals
from epochal.plans.registry import query
from epochal.sources import tables as t

W = "OVER (PARTITION BY vec_id, channel)"
KEY = ("vec_id", "channel")


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {t.PERIODS} SELECT study_id, period_idx, stage, CASE stage WHEN 0 THEN 'W' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN 'N3' ELSE 'REM' END AS name FROM periods")
def label_map(spark, sf_dir):
    names = t.label_map("stage", dict(enumerate(t.STAGE_NAMES)))
    return t.periods(spark, sf_dir).select("study_id", "period_idx", "stage", names.alias("name"))


@query(f"WITH {t.PERIODS} SELECT study_id, CAST(CASE WHEN stage IN (1, 2, 3) THEN 1 ELSE stage END AS INTEGER) AS stage, count(*) AS n FROM periods GROUP BY 1, 2")
def nrem_group(spark, sf_dir):
    grouped = t.periods(spark, sf_dir).withColumn("stage", labels.grouped(F.col("stage"), (1, 2, 3), 1))
    return grouped.groupBy("study_id", "stage").agg(F.count("*").alias("n"))


@query(f"WITH {t.PAIRS} SELECT study_id, period_idx, truth, pred FROM pairs WHERE truth BETWEEN 0 AND 3")
def in_range(spark, sf_dir):
    return metrics.in_range(t.pairs(spark, sf_dir), 4)


@query(f"""WITH {t.PAIRS}, kept AS (SELECT * FROM pairs WHERE truth <> 4), m AS (SELECT truth, pred, count(*) AS n FROM kept WHERE pred <> 4 GROUP BY 1, 2)
SELECT (SELECT count(*) FROM kept) AS scored, (SELECT CAST(sum(n) AS BIGINT) FROM m) AS in_matrix, (SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 9) FROM kept) AS accuracy""")
def ignore_classes(spark, sf_dir):
    """Scores use rows whose truth is kept, with any prediction; the matrix uses rows whose labels are both kept."""
    kept = t.pairs(spark, sf_dir).filter("truth <> 4")
    return kept.agg(F.count("*").alias("scored"), F.count_if(F.col("pred") != 4).alias("in_matrix"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 9).alias("accuracy"))


@query(f"WITH {t.PERIODS} SELECT a.study_id, a.period_idx, a.stage, b.value FROM periods a JOIN (SELECT study_id, period_idx, value FROM periods WHERE period_idx < 40) b ON a.study_id = b.study_id AND a.period_idx = b.period_idx")
def length_trim(spark, sf_dir):
    p = t.periods(spark, sf_dir)
    return labels.matched(p.select("study_id", "period_idx", "stage"), p.filter("period_idx < 40").select("study_id", "period_idx", "value"))


@query(f"""WITH {t.PERIODS}, e AS (SELECT *, min(CASE WHEN stage <> 0 THEN period_idx END) OVER (PARTITION BY study_id) AS f, max(CASE WHEN stage <> 0 THEN period_idx END) OVER (PARTITION BY study_id) AS l FROM periods)
SELECT study_id, period_idx, stage FROM e WHERE period_idx >= greatest(0, f - 1) AND period_idx < l + 1""")
def wake_trim(spark, sf_dir):
    return labels.wake_trimmed(t.periods(spark, sf_dir), 1).select("study_id", "period_idx", "stage")


@query(f"WITH {t.PERIODS} SELECT study_id, period_idx, stage FROM periods WHERE stage <> 4")
def drop_class(spark, sf_dir):
    return t.periods(spark, sf_dir).filter("stage <> 4").select("study_id", "period_idx", "stage")


SHIFTED = t.SPARSE + ", shifted AS (SELECT study_id, CAST(init_sec + study_id % 7 + 3 AS INTEGER) AS init_sec, CAST(CASE WHEN duration_sec = 30 THEN 0 ELSE duration_sec END AS INTEGER) AS duration_sec, stage FROM sparse)"


def shifted(spark, sf_dir):
    duration = F.when(F.col("duration_sec") == 30, 0).otherwise(F.col("duration_sec"))
    return t.sparse(spark, sf_dir).withColumn("init_sec", (F.col("init_sec") + F.col("study_id") % 7 + 3).cast("int")).withColumn("duration_sec", duration)


@query(f"WITH {SHIFTED} SELECT study_id, CAST(init_sec - min(init_sec) OVER (PARTITION BY study_id) AS INTEGER) AS init_sec, duration_sec, stage FROM shifted")
def offset(spark, sf_dir):
    return labels.without_offset(shifted(spark, sf_dir))


@query(f"WITH {SHIFTED} SELECT study_id, init_sec, CAST(CASE WHEN duration_sec = 0 THEN 30 ELSE duration_sec END AS INTEGER) AS duration_sec, stage FROM shifted")
def zero_dur(spark, sf_dir):
    return labels.with_least_duration(shifted(spark, sf_dir), 30)


@query(f"""WITH {t.SPARSE}, holed AS (SELECT * FROM sparse WHERE stage <> 4), n AS (SELECT *, init_sec + duration_sec AS e, lead(init_sec) OVER (PARTITION BY study_id ORDER BY init_sec) AS nx FROM holed)
SELECT study_id, init_sec, duration_sec, stage FROM holed UNION ALL SELECT study_id, CAST(e AS INTEGER), CAST(nx - e AS INTEGER), CAST(5 AS INTEGER) FROM n WHERE nx > e""")
def fill_gaps(spark, sf_dir):
    return labels.with_gaps(t.sparse(spark, sf_dir).filter("stage <> 4"), 5)


@query(f"WITH {t.SPARSE} SELECT study_id, init_sec, duration_sec, stage FROM sparse")
def rle(spark, sf_dir):
    return t.sparse(spark, sf_dir)


@query(f"WITH {t.PERIODS} SELECT study_id, period_idx, stage FROM periods")
def densify(spark, sf_dir):
    return labels.densified(t.sparse(spark, sf_dir), 30)


@query(f"""WITH {t.PERIODS}, sized AS (SELECT *, count(*) OVER (PARTITION BY study_id) AS n FROM periods), taps AS (SELECT * FROM (VALUES (1, 0.25), (0, 0.5), (-1, 0.25)) v(b, w)),
near AS (SELECT study_id, period_idx, CAST(CASE WHEN period_idx - b < 0 THEN -1 - (period_idx - b) WHEN period_idx - b >= n THEN 2 * n - 1 - (period_idx - b) ELSE period_idx - b END AS INTEGER) AS src, w FROM sized, taps)
SELECT near.study_id, near.period_idx, stage AS class, round(CAST(sum(w) AS DOUBLE), 6) AS weight FROM near JOIN periods p ON p.study_id = near.study_id AND p.period_idx = near.src GROUP BY 1, 2, 3""")
def smooth_neighbours(spark, sf_dir):
    return rounded(labels.smoothed(t.periods(spark, sf_dir).select("study_id", "period_idx", "stage"), (0.25, 0.5, 0.25), 5), "weight")


@query(f"WITH {t.SAMPLES_SQL} SELECT vec_id, channel, idx, round(x, 6) AS x FROM samples WHERE channel IN (0, 2)")
def channel_select(spark, sf_dir):
    return rounded(t.samples(spark, sf_dir).filter(F.col("channel").isin(0, 2)), "x")


@query("SELECT vec_id AS record, label AS class FROM embeddings")
def rename(spark, sf_dir):
    return t.table(spark, sf_dir, "embeddings").select("vec_id", "label").withColumnsRenamed({"vec_id": "record", "label": "class"})


@query(f"WITH {t.SAMPLES_SQL} SELECT a.vec_id, a.idx, round(a.x - b.x, 6) AS x FROM samples a JOIN samples b ON a.vec_id = b.vec_id AND a.idx = b.idx AND a.channel = 0 AND b.channel = 3")
def montage(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings")
    wide = e.select("vec_id", *(F.slice(F.col("embedding").cast("array<double>"), k * 16 + 1, 16).alias(f"ch{k}") for k in range(4)))
    return rounded(signals.montage(wide, {"ch0-ch3": ("ch0", "ch3")}).select("vec_id", F.posexplode("`ch0-ch3`").alias("idx", "x")), "x")


def scaler(how):
    def run(spark, sf_dir):
        return rounded(signals.scaled(t.samples(spark, sf_dir), how, *KEY), "x", digits=5)

    run.__name__ = f"{how}_scale"
    return run


for _how, _x in {
    "robust": f"(x - quantile_cont(x, 0.5) {W}) / nullif(quantile_cont(x, 0.75) {W} - quantile_cont(x, 0.25) {W}, 0)",
    "standard": f"(x - avg(x) {W}) / nullif(stddev_pop(x) {W}, 0)",
    "minmax": f"(x - min(x) {W}) / nullif(max(x) {W} - min(x) {W}, 0)",
    "maxabs": f"x / nullif(max(abs(x)) {W}, 0)",
    "quantile": "percent_rank() OVER (PARTITION BY vec_id, channel ORDER BY x)",
}.items():
    query(f"WITH {t.SAMPLES_SQL} SELECT vec_id, channel, idx, round({_x}, 5) AS x FROM samples")(scaler(_how))

IQR = f"iqr AS (SELECT vec_id, channel, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM samples GROUP BY 1, 2)"


@query(f"WITH {t.SAMPLES_SQL}, {IQR} SELECT vec_id, channel, idx, round(greatest(least(x, iqr), -iqr), 6) AS x FROM samples JOIN iqr USING (vec_id, channel)")
def iqr_clip(spark, sf_dir):
    return rounded(signals.clipped(t.samples(spark, sf_dir), 1.0, *KEY), "x")


@query(f"WITH {t.SAMPLES_SQL}, {IQR} SELECT vec_id, channel, idx, CASE WHEN max(abs(x)) OVER (PARTITION BY vec_id, channel, idx // 4) > 1.5 * iqr THEN 0.0 ELSE round(x, 6) END AS x FROM samples JOIN iqr USING (vec_id, channel)")
def zero_out(spark, sf_dir):
    rows = t.samples(spark, sf_dir).withColumn("epoch", F.expr("idx div 4"))
    return rounded(signals.zeroed(rows, 1.5, list(KEY), "epoch").drop("epoch"), "x")


@query(f"WITH {t.SAMPLES_SQL} SELECT vec_id, channel, CAST(idx - 3 AS INTEGER) AS idx, round(x, 6) AS x FROM samples WHERE idx >= 3")
def lead_trim(spark, sf_dir):
    return rounded(signals.lead_trimmed(t.samples(spark, sf_dir), 3), "x")


@query(f"WITH {t.SAMPLES_SQL} SELECT vec_id, channel, idx, round(x, 6) AS x FROM samples WHERE idx < 15")
def whole_second_trim(spark, sf_dir):
    return rounded(signals.whole_seconds(t.samples(spark, sf_dir), 5, *KEY), "x")


@query(f"WITH {t.SAMPLES_SQL} SELECT vec_id, channel, CAST(idx // 4 AS INTEGER) AS idx, round(avg(x), 6) AS x FROM samples GROUP BY 1, 2, 3")
def resample(spark, sf_dir):
    return rounded(signals.decimated(t.samples(spark, sf_dir), 4, *KEY), "x")


@query(f"""WITH {t.SAMPLES_SQL}, n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY vec_id, channel ORDER BY idx), x) AS nx FROM samples)
SELECT vec_id, channel, CAST(idx * 2 + j AS INTEGER) AS idx, round(x + (nx - x) * j / 2, 6) AS x FROM n, (SELECT unnest(range(2)) AS j)""")
def upsample(spark, sf_dir):
    return rounded(signals.interpolated(t.samples(spark, sf_dir), 2, *KEY), "x")


@query("SELECT vec_id, CAST(p AS INTEGER) AS place, round(list_sum(embedding[p * 8 + 1 : p * 8 + 8]::DOUBLE[]) / 8, 6) AS x FROM embeddings, (SELECT unnest(range(8)) AS p)")
def pool(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signals.pooled(F.col("embedding").cast("array<double>"), 8)).alias("place", "x"))
    return rounded(e, "x")


@query(f"WITH {t.SAMPLES_SQL} SELECT vec_id, channel, idx, (idx - 12 + 16) % 16 < 6 AS inside FROM samples")
def region_mask(spark, sf_dir):
    return t.samples(spark, sf_dir).select(*KEY, "idx", signals.in_region(F.col("idx"), 12, 6, 16).alias("inside"))


@query(f"WITH {t.SAMPLES_SQL} SELECT vec_id, channel, idx, round(CASE WHEN (idx - 12 + 16) % 16 < 6 THEN -x ELSE x END, 6) AS x FROM samples")
def region_flip(spark, sf_dir):
    return rounded(signals.flipped(t.samples(spark, sf_dir), 12, 6, 16), "x")


@query("""SELECT vec_id, CAST(i // 16 AS INTEGER) AS channel, CAST(i % 16 AS INTEGER) AS idx, round(CASE WHEN (i % 16 - 12 + 16) % 16 < 6
THEN (embedding[i + 1]::DOUBLE + embedding[i - i % 16 + (i % 16 + 7) % 16 + 1]::DOUBLE) / 2 ELSE embedding[i + 1]::DOUBLE END, 6) AS x FROM embeddings, (SELECT unnest(range(64)) AS i)""")
def region_mix(spark, sf_dir):
    return rounded(signals.mixed(t.samples(spark, sf_dir), 12, 19, 6, 16, *KEY), "x")


@query(f"WITH {t.SAMPLES_SQL}, l AS (SELECT *, coalesce(lag(x, 1) OVER w, 0) AS x1, coalesce(lag(x, 2) OVER w, 0) AS x2 FROM samples WINDOW w AS (PARTITION BY vec_id, channel ORDER BY idx)) SELECT vec_id, channel, idx, round(0.25 * x + 0.5 * x1 + 0.25 * x2, 6) AS x FROM l")
def fir_filter(spark, sf_dir):
    return rounded(signals.filtered(t.samples(spark, sf_dir), [0.25, 0.5, 0.25], *KEY), "x")


@query(f"WITH {t.SAMPLES_SQL} SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, abs(avg(x)) > 5 OR stddev_pop(x) > 5 AS suspect FROM samples")
def scale_check(spark, sf_dir):
    return rounded(signals.sanity(t.samples(spark, sf_dir)), "mean", "std")


@query(f"WITH {t.PAIRS} SELECT p.study_id, p.period_idx, p.truth, p.pred, e.value FROM pairs p JOIN periods e ON p.study_id = e.study_id AND p.period_idx = e.period_idx")
def signal_label_join(spark, sf_dir):
    values = t.periods(spark, sf_dir).select("study_id", "period_idx", "value")
    return labels.matched(t.pairs(spark, sf_dir), values)


@query(f"WITH {t.VOTES} SELECT a.study_id, a.period_idx, a.pred AS first, b.pred AS second FROM votes a JOIN votes b ON a.study_id = b.study_id AND a.period_idx = b.period_idx AND a.voter = 1 AND b.voter = 2")
def pair_join(spark, sf_dir):
    of = lambda k, name: t.votes(spark, sf_dir).filter(F.col("voter") == k).select("study_id", "period_idx", F.col("pred").alias(name))
    return labels.matched(of(1, "first"), of(2, "second"))


@query(f"""WITH {t.PERIODS}, trim AS (SELECT c_custkey AS study_id, CAST(c_custkey % 5 AS INTEGER) AS n FROM customer)
SELECT p.study_id, CAST(period_idx - n AS INTEGER) AS period_idx, stage FROM periods p JOIN trim USING (study_id) WHERE period_idx >= n""")
def trim_join(spark, sf_dir):
    """Leading periods go by a lookup per study; a study without an entry would be an error."""
    trim = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study_id"), (F.col("c_custkey") % 5).cast("int").alias("n"))
    rows = t.periods(spark, sf_dir).join(trim, "study_id", "left")
    n = F.when(F.col("n").isNull(), F.raise_error(F.lit("a study has no entry"))).otherwise(F.col("n")).cast("int")
    return rows.filter(F.col("period_idx") >= n).select("study_id", (F.col("period_idx") - F.col("n")).cast("int").alias("period_idx"), "stage")


@query(f"WITH {t.PERIODS} SELECT study_id, stage, CAST(count(*) AS INTEGER) AS n, array_to_string(list(period_idx ORDER BY period_idx), ',') AS indices FROM periods GROUP BY 1, 2")
def class_index(spark, sf_dir):
    index = labels.class_index(t.periods(spark, sf_dir))
    return index.select("study_id", "stage", F.size("indices").alias("n"), F.array_join("indices", ",").alias("indices"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_settings(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE json_extract_string(props, '$.k') END AS INTEGER) IS NULL AS failed FROM events")
def load_errors(spark, sf_dir):
    """Records that can't be read become rows of an error table instead of failures: those of errors hold no number."""
    record = "case when event_type = 'error' then props else get_json_object(props, '$.k') end"
    return t.table(spark, sf_dir, "events").select("event_id", F.expr(f"try_cast({record} as int) is null").alias("failed"))


@query("SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS rates, count(DISTINCT l_suppkey) = 1 AS equal FROM lineitem GROUP BY 1")
def equal_rates(spark, sf_dir):
    """Whether all channels of a record have one rate."""
    per = t.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("rates"))
    return per.withColumn("equal", F.col("rates") == 1)


@query(f"WITH {t.PERIODS} SELECT study_id, count(*) AS n, CAST(epoch(time_bucket(INTERVAL '30 seconds', ts)) AS BIGINT) AS epoch FROM periods GROUP BY 1, 3")
def tumbling_epochs(spark, sf_dir):
    """Periods by absolute time: 30-second windows."""
    rows = t.periods(spark, sf_dir).withColumn("epoch", F.unix_seconds(F.window("ts", "30 seconds")["start"].cast("timestamp")))
    return rows.groupBy("study_id", "epoch").agg(F.count("*").alias("n"))


@query(f"WITH {t.PERIODS}, w AS (SELECT *, avg(value) OVER (PARTITION BY study_id ORDER BY period_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM periods) SELECT study_id, period_idx, round(m, 6) AS mean FROM w")
def moving_mean(spark, sf_dir):
    frame = Window.partitionBy("study_id").orderBy("period_idx").rowsBetween(-2, 2)
    return t.periods(spark, sf_dir).select("study_id", "period_idx", F.round(F.avg("value").over(frame), 6).alias("mean"))
