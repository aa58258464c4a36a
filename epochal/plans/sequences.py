"""Queries for windows, splits, samplers and augmenters."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from epochal.operators import augment, ordering, sampling, splits, windows
from epochal.operators.sampling import normal_sql, uniform_sql
from epochal.plans.registry import query
from epochal.sources import tables as t

SIZED = t.PERIODS + ", sized AS (SELECT study_id, count(*) AS n FROM periods GROUP BY 1)"


@query(f"""WITH {SIZED}, c AS (SELECT p.study_id, period_idx AS center, CAST(least(greatest(period_idx - 2, 0), n - 5) AS INTEGER) AS s FROM periods p JOIN sized USING (study_id) WHERE n >= 5)
SELECT c.study_id, c.center, CAST(o AS INTEGER) AS offset, p.stage FROM c, (SELECT unnest(range(5)) AS o) JOIN periods p ON p.study_id = c.study_id AND p.period_idx = s + o""")
def margin_window(spark, sf_dir):
    return windows.margin_windows(t.periods(spark, sf_dir), 2, "stage")


@query(f"WITH {SIZED} SELECT a.study_id, a.period_idx AS start, a.stage * 100 + b.stage * 10 + c.stage AS code FROM periods a JOIN periods b ON a.study_id = b.study_id AND b.period_idx = a.period_idx + 1 JOIN periods c ON a.study_id = c.study_id AND c.period_idx = a.period_idx + 2")
def sliding(spark, sf_dir):
    found = windows.sliding(t.periods(spark, sf_dir), 3, "stage")
    return found.select("study_id", "start", (F.col("values")[0] * 100 + F.col("values")[1] * 10 + F.col("values")[2]).alias("code"))


@query(f"WITH {SIZED} SELECT study_id, CAST(period_idx // 8 AS INTEGER) AS chunk, CAST(period_idx % 8 AS INTEGER) AS place, stage FROM periods JOIN sized USING (study_id) WHERE period_idx < n - n % 8")
def chunk(spark, sf_dir):
    return windows.chunks(t.periods(spark, sf_dir).select("study_id", "period_idx", "stage"), 8).select("study_id", "chunk", "place", "stage")


@query(f"WITH {t.PERIODS} SELECT study_id, CAST(period_idx // 16 AS INTEGER) AS batch, count(*) AS n FROM periods GROUP BY 1, 2")
def batches(spark, sf_dir):
    return windows.batches(t.periods(spark, sf_dir), 16)


CUM = SIZED + ", cum AS (SELECT study_id, n, greatest(n - 4, 0) AS usable, CAST(sum(greatest(n - 4, 0)) OVER (ORDER BY study_id) AS BIGINT) AS cum FROM sized)"


@query(f"WITH {CUM} SELECT study_id, n, usable, cum FROM cum")
def cum_periods(spark, sf_dir):
    return windows.cumulative(windows.study_sizes(t.periods(spark, sf_dir)), 2).withColumn("usable", F.col("usable").cast("bigint"))


@query(f"WITH {CUM}, g AS (SELECT unnest(range((SELECT (max(cum) + 49) // 50 FROM cum))) AS batch) SELECT CAST(batch AS BIGINT) AS batch, study_id, CAST(batch * 50 - (cum - usable) + 2 AS BIGINT) AS center FROM g JOIN cum ON cum - usable <= batch * 50 AND batch * 50 < cum")
def batch_locate(spark, sf_dir):
    return windows.located(windows.study_sizes(t.periods(spark, sf_dir)), 50, 2)


@query(f"WITH {SIZED} SELECT CAST(count(*) AS BIGINT) AS studies, CAST(sum(n) AS BIGINT) AS periods, CAST(min(n) AS BIGINT) AS least FROM sized")
def study_totals(spark, sf_dir):
    return windows.study_sizes(t.periods(spark, sf_dir)).agg(F.count("*").alias("studies"), F.sum("n").alias("periods"), F.min("n").alias("least"))


ORDER = "row_number() OVER (ORDER BY md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '7')))"
SUBJECTS = f"subjects AS (SELECT c_custkey, {ORDER} AS nth, count(*) OVER () AS n FROM customer), split AS (SELECT c_custkey, CASE WHEN nth <= ceil(n * 0.15) THEN 'test' WHEN nth <= ceil(n * 0.15) + ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM subjects)"


def subjects(spark, sf_dir):
    return t.table(spark, sf_dir, "customer").select("c_custkey")


@query(f"WITH {SUBJECTS} SELECT c_custkey, split FROM split")
def split_assign(spark, sf_dir):
    return splits.assigned(subjects(spark, sf_dir), "c_custkey", 0.15, 0.1, 7)


@query(f"""WITH {SUBJECTS}, r AS (SELECT split, count(*) AS records, count(DISTINCT c_custkey) AS subjects FROM split JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT split, records, subjects FROM r UNION ALL SELECT 'total', CAST(sum(records) AS BIGINT), CAST(sum(subjects) AS BIGINT) FROM r""")
def split_sizes(spark, sf_dir):
    records = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return splits.split_counts(splits.followed(records, split_assign(spark, sf_dir), "c_custkey"), "c_custkey")


@query(f"SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '7'))) - 1 AS INTEGER) AS fold FROM customer")
def kfold(spark, sf_dir):
    return splits.folds(subjects(spark, sf_dir), "c_custkey", 4, 7)


@query(f"WITH f AS (SELECT c_custkey, CAST(ntile(4) OVER (ORDER BY md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '7'))) - 1 AS INTEGER) AS fold FROM customer) SELECT c_custkey FROM f WHERE fold <> 2")
def other_folds(spark, sf_dir):
    every = kfold(spark, sf_dir)
    return every.select("c_custkey").subtract(every.filter("fold = 2").select("c_custkey"))


@query("SELECT regexp_extract(c_name, '0*([0-9]+)[0-9]$', 1) AS name, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1")
def group_names(spark, sf_dir):
    named = t.table(spark, sf_dir, "customer").select(splits.name_group("c_name", "0*([0-9]+)[0-9]$").alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT left(c_name, 16) AS prefix, count(*) AS n FROM customer GROUP BY 1")
def prefix_groups(spark, sf_dir):
    return t.table(spark, sf_dir, "customer").groupBy(F.left("c_name", F.lit(16)).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '3'))) AS nth FROM customer")
def seeded_order(spark, sf_dir):
    """A shuffle: all rows with their places in it."""
    return ordering.numbered_by_digest(subjects(spark, sf_dir), "nth", splits.shuffled_key("c_custkey", 3)).drop("nth_total")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '5'))) AS r FROM documents) WHERE r <= 3")
def random_studies(spark, sf_dir):
    return splits.n_per_group(t.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3, 5)


@query("SELECT source AS dataset, doc_id AS study_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20")
def val_cap(spark, sf_dir):
    return sampling.validation_studies(t.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").alias("study_id")), 20)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def train_val_union(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    of = lambda *p: orders.filter(F.col("o_orderpriority").isin(*p)).select("o_orderkey", "o_custkey")
    return of("1-URGENT", "2-HIGH").unionByName(of("5-LOW"))


@query(f"""WITH {SIZED}, nth AS (SELECT study_id, n, row_number() OVER (ORDER BY study_id) AS nth, count(*) OVER () AS total FROM sized), d AS (SELECT unnest(range(512)) AS draw),
c AS (SELECT draw, study_id, n, CAST(floor({uniform_sql(2, "draw")} * n) AS INTEGER) AS center FROM d JOIN nth ON nth = floor({uniform_sql(1, "draw")} * total) + 1)
SELECT c.draw, c.study_id, center, CAST(o AS INTEGER) AS offset, stage FROM c, (SELECT unnest(range(5)) AS o) JOIN periods p ON p.study_id = c.study_id AND p.period_idx = least(greatest(center - 2, 0), n - 5) + o WHERE n >= 5""")
def random_batch(spark, sf_dir):
    """A uniform study, then a uniform period, as windows with margins: only the drawn windows are unfolded."""
    rows = t.periods(spark, sf_dir)
    drawn = sampling.random_periods(rows, 512, 1).filter("n >= 5").withColumnRenamed("period_idx", "center")
    begin = F.least(F.greatest(F.col("center") - 2, F.lit(0)), F.col("n") - 5)
    drawn = drawn.withColumn("begin", begin).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("period_idx", (F.col("begin") + F.col("offset")).cast("int"))
    return drawn.join(rows, ["study_id", "period_idx"]).select("draw", "study_id", "center", "offset", "stage")


@query(f"""WITH {t.PERIODS}, a AS (SELECT study_id, period_idx, stage, row_number() OVER (PARTITION BY stage, study_id ORDER BY {uniform_sql(1, "study_id", "period_idx")}) AS turn FROM periods),
b AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY turn, {uniform_sql(2, "study_id", "period_idx")}) AS nth FROM a) SELECT study_id, period_idx, stage FROM b WHERE nth <= 64""")
def balanced_batch(spark, sf_dir):
    return sampling.balanced_periods(t.periods(spark, sf_dir), 64, 1)


CLASS_WEIGHTS = {0: 1.0, 1: 1.0, 2: 2.0, 3: 1.0, 4: 3.0}
_until = [sum(list(CLASS_WEIGHTS.values())[: c + 1]) / sum(CLASS_WEIGHTS.values()) for c in range(5)]
_class = "CASE " + " ".join(f"WHEN {uniform_sql(2, 'draw')} < {x!r} THEN {c}" for c, x in enumerate(_until)) + " ELSE 4 END"


@query(f"""WITH {t.PERIODS}, sets AS (SELECT *, concat('d', study_id % 3) AS dataset, count(*) OVER (PARTITION BY study_id) AS n FROM periods),
sizes AS (SELECT dataset, count(*) AS n FROM sets GROUP BY 1), prob AS (SELECT dataset, 0.5 * n / CAST(sum(n) OVER () AS DOUBLE) + 0.5 / count(*) OVER () AS p FROM sizes),
cum AS (SELECT dataset, p, sum(p) OVER (ORDER BY dataset) AS cum, row_number() OVER (ORDER BY dataset DESC) AS last FROM prob),
draws AS (SELECT draw, {uniform_sql(1, "draw")} AS u, {_class} AS class FROM (SELECT unnest(range(1000)) AS draw)),
one AS (SELECT draw, dataset, class FROM draws JOIN cum ON u >= cum - p AND (u < cum OR last = 1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY study_id, stage ORDER BY period_idx) - 1 AS place FROM sets WHERE n >= 5),
held AS (SELECT dataset, stage, study_id, n, count(*) AS k, row_number() OVER (PARTITION BY dataset, stage ORDER BY md5(concat_ws('|', CAST(study_id AS VARCHAR), '1'))) AS nth, count(*) OVER (PARTITION BY dataset, stage) AS studies FROM placed GROUP BY dataset, stage, study_id, n),
two AS (SELECT draw, one.dataset, class, study_id, n, floor({uniform_sql(4, "draw")} * k) AS place FROM one JOIN held ON held.dataset = one.dataset AND stage = class AND nth = floor({uniform_sql(3, "draw")} * studies) + 1),
three AS (SELECT two.*, period_idx + CAST(floor({uniform_sql(5, "draw")} * 5) AS INTEGER) - 2 AS center FROM two JOIN placed ON placed.study_id = two.study_id AND placed.stage = class AND placed.place = two.place)
SELECT draw, dataset, CAST(class AS INTEGER) AS class, three.study_id, CAST(center AS INTEGER) AS center, CAST(o AS INTEGER) AS offset, stage FROM three, (SELECT unnest(range(5)) AS o) JOIN periods p ON p.study_id = three.study_id AND p.period_idx = least(greatest(center - 2, 0), n - 5) + o""")
def weighted_batch(spark, sf_dir):
    """Dataset, class, study, period and window of each draw."""
    from epochal.operators import metrics

    rows = t.periods(spark, sf_dir).withColumn("dataset", F.concat(F.lit("d"), F.col("study_id") % 3))
    sizes = rows.groupBy("dataset").agg(F.count("*").alias("n"))
    return sampling.weighted_windows(rows, metrics.sampling_probability(sizes), CLASS_WEIGHTS, 1000, 2, 1)


@query(f"""WITH {CUM}, total AS (SELECT CAST(max(cum) AS BIGINT) AS total FROM cum), e AS (SELECT place, total, {ordering.permuted_sql("place", "total", "epoch 3")} AS w FROM (SELECT total, unnest(range(total)) AS place FROM total))
SELECT CAST(place * 7 // total AS INTEGER) AS reader, place, study_id, CAST(w - (cum - usable) + 2 AS BIGINT) AS center FROM e JOIN cum ON w >= cum - usable AND w < cum""")
def epoch_slices(spark, sf_dir):
    """One shuffled epoch of all windows for seven readers."""
    return windows.epoch_order(windows.study_sizes(t.periods(spark, sf_dir)), 2, "epoch 3", 7)


@query(f"""WITH p AS (SELECT source AS dataset, 0.5 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) + 0.5 / count(*) OVER () AS p FROM documents GROUP BY 1),
cum AS (SELECT dataset, p, sum(p) OVER (ORDER BY dataset) AS cum, row_number() OVER (ORDER BY dataset DESC) AS last FROM p), d AS (SELECT draw, {uniform_sql(1, "draw")} AS u FROM (SELECT unnest(range(1000)) AS draw))
SELECT draw, dataset FROM d JOIN cum ON u >= cum - p AND (u < cum OR last = 1)""")
def dataset_batch(spark, sf_dir):
    from epochal.operators import metrics

    sizes = t.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n"))
    return sampling.mixed_batches(metrics.sampling_probability(sizes), 1000, 1)


def elements(spark, sf_dir):
    return t.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def unfolded(df):
    return df.select("vec_id", F.posexplode("x").alias("place", "x")).withColumn("x", F.round("x", 5))


#: One row per component, with its element and a drawn region of it.
ELEMENTS = "e AS (SELECT vec_id, embedding::DOUBLE[] AS xs, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM embeddings)"
LOW, HIGH = 0.1, 0.5


def region_sql(seed):
    length = f"floor(pow(10, log10({LOW}) + {uniform_sql(seed, 'vec_id', "'length'")} * (log10({HIGH}) - log10({LOW}))) * n)"
    start = start_sql(seed, "start")
    return f"{ELEMENTS}, r AS (SELECT *, xs[i + 1] AS v, list_avg(xs) AS m, ((i - {start}) % n + n) % n < {length} AS inside, {start} AS start FROM e)"


def start_sql(seed, name):
    return f"CAST(floor({uniform_sql(seed, 'vec_id', f"'{name}'")} * n) AS BIGINT)"


def placed(value, source="r"):
    return f"SELECT vec_id, CAST(i AS INTEGER) AS place, round({value}, 5) AS x FROM {source}"


def parameter_sql(low, high, seed):
    return f"({low} + ({high} - {low}) * {uniform_sql(seed, 'vec_id', "'parameter'")})"


NOISE, OTHER = normal_sql(1, "vec_id", "i"), start_sql(3, "other")


@query(f"WITH {ELEMENTS} {placed(f'xs[i + 1] * {parameter_sql(0.5, 2.0, 1)}', 'e')}")
def augment_amplitude(spark, sf_dir):
    return unfolded(elements(spark, sf_dir).withColumn("x", augment.amplitude(F.col("x"), augment.between(0.5, 2.0, "vec_id", 1))))


@query(f"WITH {ELEMENTS} {placed(f'xs[i + 1] + {parameter_sql(-0.5, 0.5, 1)}', 'e')}")
def augment_shift(spark, sf_dir):
    return unfolded(elements(spark, sf_dir).withColumn("x", augment.shift(F.col("x"), augment.between(-0.5, 0.5, "vec_id", 1))))


@query(f"WITH {region_sql(1)} {placed(f'CASE WHEN inside THEN m + 0.01 * {NOISE} ELSE v END')}")
def augment_erase(spark, sf_dir):
    """A drawn region gives way to faint noise about the mean."""
    region = augment.drawn_region(F.col("x"), "vec_id", LOW, HIGH, 1)
    return unfolded(elements(spark, sf_dir).withColumn("x", augment.erase(F.col("x"), *region, "vec_id", 1)))


@query(f"WITH {region_sql(2)} {placed('CASE WHEN inside THEN -v ELSE v END')}")
def augment_sign_flip(spark, sf_dir):
    return unfolded(elements(spark, sf_dir).withColumn("x", augment.sign_flip(F.col("x"), *augment.drawn_region(F.col("x"), "vec_id", LOW, HIGH, 2))))


@query(f"WITH {region_sql(3)} {placed(f'CASE WHEN inside THEN (v + xs[(i + {OTHER} - start + n) % n + 1]) / 2 ELSE v END')}")
def augment_signal_mix(spark, sf_dir):
    start, length = augment.drawn_region(F.col("x"), "vec_id", LOW, HIGH, 3)
    other = augment.drawn_start(F.col("x"), "vec_id", "other", 3)
    return unfolded(elements(spark, sf_dir).withColumn("x", augment.signal_mix(F.col("x"), start, other, length)))


@query(f"WITH {ELEMENTS} {placed(f'xs[i + 1] + 0.1 * {NOISE}', 'e')}")
def augment_noise(spark, sf_dir):
    return unfolded(augment.noisy(elements(spark, sf_dir), "vec_id", "x", 0.1, 1))


KERNEL = augment.smoothing(4.0)


@query(f"""WITH {ELEMENTS}, k AS (SELECT unnest(range({len(KERNEL)})) AS j, unnest([{", ".join(map(repr, KERNEL))}]::DOUBLE[]) AS w),
d AS (SELECT vec_id, i, any_value(n) AS n, any_value(xs) AS xs, sum(w * (2 * {uniform_sql(1, "vec_id", "i + j")} - 1)) AS moved FROM e, k GROUP BY 1, 2),
p AS (SELECT *, greatest(0.0, least(n - 1.0, i + 2.0 * moved)) AS p FROM d) {placed("xs[floor(p)::INTEGER + 1] + (p - floor(p)) * (xs[least(n - 1, floor(p)::INTEGER + 1) + 1] - xs[floor(p)::INTEGER + 1])", "p")}""")
def augment_elastic(spark, sf_dir):
    return unfolded(augment.elastic(elements(spark, sf_dir), "vec_id", "x", 2.0, 4.0, 1))


@query(f"""WITH {ELEMENTS}, h AS (SELECT *, {uniform_sql(1, "vec_id")} < 0.5 AS hit FROM e)
SELECT vec_id, CASE WHEN hit THEN 0.33 ELSE 1.0 END::DOUBLE AS weight, CAST(i AS INTEGER) AS place, round(CASE WHEN hit THEN xs[i + 1] * {parameter_sql(0.5, 2.0, 2)} ELSE xs[i + 1] END, 5) AS x FROM h""")
def augment_drawn(spark, sf_dir):
    """Each element's amplitude changes with probability one half, by a drawn factor."""
    rows = elements(spark, sf_dir).withColumn("weight", F.lit(1.0))
    done = augment.drawn(rows, "vec_id", "x", lambda x: augment.amplitude(x, augment.between(0.5, 2.0, "vec_id", 2)), 0.5, 1, 0.33)
    return done.select("vec_id", "weight", F.posexplode("x").alias("place", "x")).withColumn("x", F.round("x", 5))


@query(f"""WITH c AS (SELECT vec_id, c, 'ch' || c AS name, embedding[c * 16 + 1 : c * 16 + 16]::DOUBLE[] AS xs FROM embeddings, (SELECT unnest(range(4)) AS c)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY {uniform_sql(1, "vec_id", "name")}) <= 2 AS gone FROM c), i AS (SELECT *, unnest(range(16)) AS i FROM r)
SELECT vec_id, name AS channel, CAST(i AS INTEGER) AS place, round(CASE WHEN gone THEN list_avg(xs) + 0.01 * {normal_sql(1, "vec_id", "name", "i")} ELSE xs[i + 1] END, 5) AS x FROM i""")
def augment_channel_dropout(spark, sf_dir):
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", *(F.slice(F.col("embedding").cast("array<double>"), k * 16 + 1, 16).alias(f"ch{k}") for k in range(4)))
    names = [f"ch{k}" for k in range(4)]
    done = e.withColumns(dict(augment.channel_dropout(names, "vec_id", 0.5, 1)))
    every = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in names))).alias("c")
    done = done.select("vec_id", every).select("vec_id", F.col("c.channel").alias("channel"), F.posexplode("c.x").alias("place", "x"))
    return done.withColumn("x", F.round("x", 5))


@query(f"WITH {t.PERIODS} SELECT study_id, period_idx, CAST(sum(stage) OVER (PARTITION BY study_id ORDER BY period_idx) AS BIGINT) AS total FROM periods")
def running_stage(spark, sf_dir):
    return t.periods(spark, sf_dir).select("study_id", "period_idx", F.sum("stage").over(Window.partitionBy("study_id").orderBy("period_idx")).alias("total"))


@query(f"WITH {region_sql(1)} {placed(f'CASE WHEN inside THEN v + 0.1 * {NOISE} ELSE v END')}")
def augment_regional_noise(spark, sf_dir):
    return unfolded(augment.noisy_region(elements(spark, sf_dir), "vec_id", "x", 0.1, LOW, HIGH, 1))


@query()
def segmenter(spark, sf_dir):
    """Confusion counts of a segmenter fit on two thirds of the studies, on the others."""
    from epochal.operators import metrics, segment

    rows = segment.features(t.periods(spark, sf_dir))
    model = segment.fit(rows.filter("study_id % 3 <> 0"))
    return metrics.confusion(segment.staged(model, rows.filter("study_id % 3 = 0")), 5)


@query()
def network_scores(spark, sf_dir):
    """Class scores per period of a convolutional network over four-channel records."""
    from epochal.operators import segment

    names = [f"ch{k}" for k in range(4)]
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", *(F.slice(F.col("embedding").cast("array<double>"), k * 16 + 1, 16).alias(c) for k, c in enumerate(names)))
    done = segment.scored(e, "vec_id", names, segment.random_net(4, 5), 4)
    return done.select("vec_id", "period_idx", F.round(F.array_max("scores"), 6).alias("best"))
