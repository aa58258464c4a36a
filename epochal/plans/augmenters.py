"""Queries for augmenters, losses and metrics that configurations name."""

from pyspark.sql import functions as F

from epochal.functions import scalars
from epochal.operators import augment, augmenting, losses
from epochal.operators.sampling import normal_sql, uniform_sql
from epochal.plans.registry import query
from epochal.plans.sequences import ELEMENTS, elements, placed, start_sql, unfolded
from epochal.sources import tables as t


def inside_sql(seed, low, high, log_sample, n):
    u = uniform_sql(seed, "vec_id", "'length'")
    even = f"floor(floor({low} * {n}) + {u} * (floor({high} * {n}) - floor({low} * {n})))"
    length = f"floor(pow(10, log10({low}) + {u} * (log10({high}) - log10({low}))) * {n})" if log_sample else even
    return f"((i - {start_sql(seed, 'start')}) % {n} + {n}) % {n} < {length}"


@query(f"WITH {ELEMENTS} {placed(f'CASE WHEN {inside_sql(4, 0.1, 0.5, False, "n")} THEN -xs[i + 1] ELSE xs[i + 1] END', 'e')}")
def augment_uniform_region(spark, sf_dir):
    """The sign of a region whose length is uniform between two shares."""
    region = augment.drawn_region(F.col("x"), "vec_id", 0.1, 0.5, 4, log_sample=False)
    return unfolded(elements(spark, sf_dir).withColumn("x", augment.sign_flip(F.col("x"), *region)))


SIGMA, ALPHA = (2.0, 4.0), (5.0, 20.0)
REACH = int(3 * SIGMA[1])


def _between(bounds, name):
    return f"({bounds[0]} + ({bounds[1]} - {bounds[0]}) * {uniform_sql(5, 'vec_id', f"'{name}'")})"


@query(f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS xs, len(embedding) AS n, {_between(SIGMA, "sigma")} AS s, {_between(ALPHA, "alpha")} AS a FROM embeddings),
w AS (SELECT vec_id, unnest(range(-{REACH}, {REACH + 1})) AS k, s FROM e), g AS (SELECT vec_id, k, CASE WHEN abs(k) <= greatest(1, floor(3 * s)) THEN exp(-0.5 * pow(k / s, 2)) ELSE 0 END AS g FROM w),
h AS (SELECT vec_id, k, g / sum(g) OVER (PARTITION BY vec_id) AS g FROM g), m AS (SELECT vec_id, i, 2 * {uniform_sql(5, "vec_id", "i")} - 1 AS move FROM (SELECT vec_id, unnest(range(n)) AS i FROM e)),
d AS (SELECT vec_id, m.i - k AS i, sum(g * move) AS d FROM h JOIN m USING (vec_id) GROUP BY 1, 2), p AS (SELECT e.*, i, i + a * d AS p FROM e JOIN d USING (vec_id) WHERE i BETWEEN 0 AND n - 1),
q AS (SELECT *, floor(p)::INTEGER AS f, p >= 0 AND p <= n - 1 AS inside FROM p)
SELECT vec_id, CAST(i AS INTEGER) AS place, CAST(CASE WHEN inside THEN (label + CAST(ceil(p - 0.5) AS INTEGER) // 8) % 5 ELSE 0 END AS INTEGER) AS stage,
round(CASE WHEN inside THEN xs[f + 1] + (p - f) * (xs[least(n - 1, f + 1) + 1] - xs[f + 1]) ELSE 0 END, 5) AS x FROM q""")
def augment_elastic_labels(spark, sf_dir):
    """Strength and smoothness drawn for each element; labels move along, to the nearest place."""
    stages = F.transform("x", lambda v, i: (F.col("label") + F.floor(i / 8)).cast("int") % 5)
    rows = t.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).withColumn("stages", stages)
    steps = [{"cls_name": "GlobalElasticDeformations", "kwargs": {"alpha": ALPHA, "sigma": SIGMA, "apply_prob": 1.0}}]
    done = augmenting.augmented(rows, augmenting.Elements("vec_id", ["x"], "stages"), steps, 5)
    both = F.posexplode(F.arrays_zip("x", "stages")).alias("place", "of")
    return done.select("vec_id", both).select("vec_id", "place", F.col("of.stages").alias("stage"), F.round("of.x", 5).alias("x"))


CHAIN = [
    {"cls_name": "GlobalAmplitude", "kwargs": {"min_scaling": 0.5, "max_scaling": 2.0, "apply_prob": 0.5, "aug_weight": 0.33}},
    {"cls_name": "RegionalSignFlip", "kwargs": {"min_region_fraction": 0.1, "max_region_fraction": 0.5, "log_sample": False, "apply_prob": 0.4}},
    {"cls_name": "RegionalGaussianNoise", "kwargs": {"min_region_fraction": 0.1, "max_region_fraction": 0.5, "sigma": 0.1, "apply_prob": 0.6}},
    {"cls_name": "RegionalErase", "kwargs": {"min_region_fraction": 0.05, "max_region_fraction": 0.33, "log_sample": False, "apply_prob": 0.3}},
]


def _hit(k):
    return f"{uniform_sql(7 + k, 'vec_id')} < {CHAIN[k]['kwargs']['apply_prob']}"


def _weight(k):
    return f"CASE WHEN {_hit(k)} THEN {CHAIN[k]['kwargs'].get('aug_weight', 0.5)} ELSE 1.0 END"


@query(f"""WITH e AS (SELECT vec_id, 'ch' || c AS channel, 32 AS n, i, embedding[c * 32 + i + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(2)) AS c), (SELECT unnest(range(32)) AS i)),
a AS (SELECT * REPLACE (CASE WHEN {_hit(0)} THEN x * (0.5 + 1.5 * {uniform_sql(7, "vec_id", "'parameter'")}) ELSE x END AS x) FROM e),
b AS (SELECT * REPLACE (CASE WHEN {_hit(1)} AND {inside_sql(8, 0.1, 0.5, False, 32)} THEN -x ELSE x END AS x) FROM a),
c AS (SELECT * REPLACE (CASE WHEN {_hit(2)} AND {inside_sql(9, 0.1, 0.5, True, 32)} THEN x + 0.1 * {normal_sql(9, "vec_id", "channel", "i")} ELSE x END AS x) FROM b),
m AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS m FROM c)
SELECT vec_id, channel, CAST(i AS INTEGER) AS place, round(CAST({" * ".join(_weight(k) for k in range(4))} AS DOUBLE), 6) AS weight,
round(CASE WHEN {_hit(3)} AND {inside_sql(10, 0.05, 0.33, False, 32)} THEN m + 0.01 * {normal_sql(10, "vec_id", "channel", "i")} ELSE x END, 5) AS x FROM m""")
def augment_chain(spark, sf_dir):
    """Four augmenters of a configuration over two channels, each with its probability and weight."""
    x = F.col("embedding").cast("array<double>")
    rows = t.table(spark, sf_dir, "embeddings").select("vec_id", F.slice(x, 1, 32).alias("ch0"), F.slice(x, 33, 32).alias("ch1"))
    done = augmenting.augmented(rows, augmenting.Elements("vec_id", ["ch0", "ch1"]), CHAIN, 7)
    every = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in ("ch0", "ch1")))).alias("c")
    done = done.select("vec_id", F.round("weight", 6).alias("weight"), every)
    return done.select("vec_id", "weight", F.col("c.channel").alias("channel"), F.posexplode("c.x").alias("place", "x")).withColumn("x", F.round("x", 5))


MEASURES = {"SparseCategoricalCrossentropy": {}, "SparseCategoricalFocalLoss": {"gamma": 2.0}, "SparseCategoricalAccuracy": {}, "SparseTopKCategoricalAccuracy": {"k": 5}, "SparseDiceLoss": {"smooth": 1.0}}


@query("""WITH s AS (SELECT vec_id, label, c, (label * 3 + c) % 18 AS truth, i, exp(embedding[c * 16 + i + 1]::DOUBLE) AS e FROM embeddings, (SELECT unnest(range(4)) AS c), (SELECT unnest(range(16)) AS i)),
p AS (SELECT vec_id, label, c, truth, i, e / sum(e) OVER (PARTITION BY vec_id, c) AS y FROM s WHERE truth < 16), q AS (SELECT *, CASE WHEN i = truth THEN 1.0 ELSE 0.0 END AS t, max(CASE WHEN i = truth THEN y END) OVER (PARTITION BY vec_id, c) AS own FROM p),
r AS (SELECT vec_id, label, c, any_value(truth) AS truth, any_value(own) AS own, count(*) FILTER (WHERE y > own) AS above, arg_min(i, (-y, i)) AS best FROM q GROUP BY vec_id, label, c),
d AS (SELECT label, i, (2 * sum(t * y) + 1) / (sum(t + y) + 1) AS d FROM q GROUP BY 1, 2), n AS (SELECT label, avg(-ln(own)) AS a, avg(pow(1 - own, 2) * -ln(own)) AS f, avg(CASE WHEN best = truth THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN above < 5 THEN 1.0 ELSE 0.0 END) AS k FROM r GROUP BY 1)
SELECT label, 'SparseCategoricalCrossentropy' AS name, round(a, 6) AS value FROM n UNION ALL SELECT label, 'SparseCategoricalFocalLoss', round(f, 6) FROM n UNION ALL SELECT label, 'SparseCategoricalAccuracy', round(b, 6) FROM n
UNION ALL SELECT label, 'SparseTopKCategoricalAccuracy', round(k, 6) FROM n UNION ALL SELECT label, 'SparseDiceLoss', round(1 - avg(d), 6) FROM d GROUP BY 1""")
def losses_by_name(spark, sf_dir):
    """Losses and metrics of all channels' scores per label, without the rows whose class is out of bounds."""
    rows = t.scores(spark, sf_dir).withColumn("truth", (F.col("label") * 3 + F.col("channel")) % 18).withColumn("scores", scalars.softmax(F.col("scores")))
    return losses.measured(rows, MEASURES, ["label"], ignore_out_of_bounds=True).withColumn("value", F.round("value", 6))
