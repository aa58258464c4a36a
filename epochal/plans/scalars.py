"""Queries for scalar functions."""

from pyspark.sql import functions as F

from epochal.functions import scalars
from epochal.plans.registry import query
from epochal.sources import tables as t


@query("SELECT page_id, regexp_replace(split_part(url, '/', -1), '[.][^.]*$', '') AS name FROM pages")
def base_names(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", scalars.base_name(F.col("url")).alias("name"))


@query("SELECT c_custkey, (c_custkey % 3) * 86400 + (c_custkey % 24) * 3600 + (c_custkey % 60) * 60 + c_custkey % 59 AS seconds FROM customer")
def durations(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.format_string("%02dd %02dh %02dm %02ds", k % 3, k % 24, k % 60, k % 59)
    return t.table(spark, sf_dir, "customer").select("c_custkey", scalars.seconds_in(text).alias("seconds"))


@query("SELECT vec_id, CAST(c AS INTEGER) AS class, round(CASE WHEN label = c THEN 1.0 ELSE 0.0 END * 0.9 + 0.1 / 10, 9) AS y FROM embeddings, (SELECT unnest(range(10)) AS c)")
def smooth_labels(spark, sf_dir):
    """One-hot labels evenly smoothed."""
    y = scalars.evenly_smoothed(scalars.one_hot(F.col("label"), 10), 0.1)
    return t.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(y).alias("class", "y")).withColumn("y", F.round("y", 9))


@query("SELECT p_partkey, CAST(floor((p_size * 10 + 4 - 4 - 1) / 2) + 1 AS INTEGER) AS n FROM part")
def conv_sizes(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select("p_partkey", scalars.conv_size(F.col("p_size") * 10, 5, 2, 2).alias("n"))


@query("""WITH x AS (SELECT vec_id, i, exp(CAST(embedding[i + 1] AS DOUBLE)) AS e FROM embeddings, (SELECT unnest(range(64)) AS i))
SELECT vec_id, CAST(i AS INTEGER) AS class, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM x""")
def softmax_scores(spark, sf_dir):
    scores = F.col("embedding").cast("array<double>")
    return t.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scalars.softmax(scores)).alias("class", "p")).withColumn("p", F.round("p", 6))


@query("SELECT vec_id, CAST(i AS INTEGER) AS place, CAST(embedding[(60 + i) % 64 + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(10)) AS i)")
def wrapped_take(spark, sf_dir):
    taken = scalars.taken_around(F.col("embedding").cast("array<double>"), F.lit(60), F.lit(10))
    return t.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(taken).alias("place", "x"))
