"""Queries that run as streams over all events there are, or over archives laid out by study, and the batch SQL that they must equal."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.plans.registry import query
from epochal.sources import archive
from epochal.sources import tables as t
from epochal.sources.shared import new_path
from epochal.streaming import epochs, monitor

START = "CAST(epoch(time_bucket(INTERVAL '{}', ts)) AS BIGINT)"


@query(f"SELECT user_id, {START.format('30 seconds')} AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return epochs.drained(epochs.tumbling(epochs.events(spark, sf_dir), "30 seconds", "1 minute", "user_id"), "complete")


@query(f"""WITH w AS (SELECT event_type, value, {START.format('5 minutes')} - 300 * k AS start FROM events, (SELECT unnest(range(2)) AS k))
SELECT event_type, CAST(start AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    return epochs.drained(epochs.sliding(epochs.events(spark, sf_dir), "10 minutes", "5 minutes", "1 minute", "event_type"), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS turn FROM events),
r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM r GROUP BY user_id, run""")
def stream_sessions(spark, sf_dir):
    return epochs.drained(epochs.sessions(epochs.events(spark, sf_dir), "6 hours", "1 minute", "user_id"), "complete")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """Every event twice, each kept once."""
    twice = epochs.events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return epochs.drained(epochs.once(twice, "event_id", "1 day").select("event_id", "user_id", "event_type"), "append")


@query("SELECT event_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id")
def stream_enriched(spark, sf_dir):
    labels = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return epochs.drained(epochs.enriched(epochs.events(spark, sf_dir), labels, "user_id").select("event_id", "c_mktsegment"), "append")


@query("""WITH f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f), c AS (SELECT user_id, event_type AS stage, CAST(run AS BIGINT) AS run, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT * FROM c WHERE run < (SELECT max(d.run) FROM c d WHERE d.user_id = c.user_id)""")
def stream_runs(spark, sf_dir):
    """Closed runs; the last run of each user is still open."""
    return epochs.drained(epochs.runs(epochs.events(spark, sf_dir)), "append")


@query("""WITH w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 hour' AS w FROM events), e AS (SELECT events.*, w FROM events, w WHERE ts <= w),
f AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER o AND ts <= lag(ts) OVER o + INTERVAL '6 hours' THEN 0 ELSE 1 END AS turn FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f),
c AS (SELECT user_id, event_type AS stage, run, epoch_us(min(ts)) AS start, count(*) AS n, max(ts) + INTERVAL '6 hours' <= max(w) AS idle FROM r GROUP BY 1, 2, 3)
SELECT user_id, stage, start, n FROM c WHERE idle OR run < (SELECT max(d.run) FROM c d WHERE d.user_id = c.user_id)""")
def stream_ordered_runs(spark, sf_dir):
    """Runs that are closed by another type or by six hours of silence, as far as the watermark has come."""
    with epochs.rocksdb(spark):
        return epochs.drained(epochs.ordered_runs(epochs.events(spark, sf_dir), "1 hour", 6 * 3600), "append")


@query(f"WITH {t.PAIRS}, c AS (SELECT unnest(range(5)) AS class) SELECT CAST(class AS INTEGER) AS class, count(*) FILTER (truth = class AND pred = class) AS tp, count(*) FILTER (truth = class) AS relevant, count(*) FILTER (pred = class) AS selected FROM pairs, c GROUP BY class")
def stream_counters(spark, sf_dir):
    """Validation counters that a listener writes while a stream scores its rows."""
    stage = t.label_map("event_type", {k: i for i, k in enumerate(t.STAGES)})
    right = F.pmod(F.col("event_id") * 3 + F.floor("value"), F.lit(7)) < 4
    rows = epochs.events(spark, sf_dir).select(stage.alias("truth"), F.when(right, stage).otherwise((stage + 1) % 5).alias("pred"))
    path = new_path(spark, "counters")
    with monitor.CounterLog(spark, "validation", path) as log:
        log.awaited(monitor.counted(rows, 5, "validation").writeStream.format("noop").option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start())
    return monitor.counters(spark, path)


@query(f"WITH {t.PERIODS} SELECT a.study_id, a.period_idx, a.stage, round(b.value, 6) AS value, (SELECT count(*) FROM periods c WHERE c.study_id = a.study_id AND c.period_idx BETWEEN a.period_idx - 2 AND a.period_idx + 2 AND c.stage = a.stage) AS alike FROM periods a JOIN periods b USING (study_id, period_idx)")
def study_archive(spark, sf_dir):
    """Labels and signals as two archives by study, joined and seen through windows without a shuffle."""
    rows, names = t.periods(spark, sf_dir), []
    for part, column in (("labels", "stage"), ("signals", "value")):
        path = new_path(spark, part)
        names.append(path.rsplit("/", 1)[1].replace("-", "_"))
        archive.write_by_study(rows.select("study_id", "period_idx", column), names[-1], path, 8)
    near = F.collect_list("stage").over(Window.partitionBy("study_id").orderBy("period_idx").rowsBetween(-2, 2))
    labels, signals = (spark.table(n) for n in names)
    labels = labels.withColumn("alike", F.size(F.filter(near, lambda x: x == F.col("stage"))).cast("long"))
    return archive.joined(labels, signals).withColumn("value", F.round("value", 6))
