"""Queries for evaluation and voting."""

from pyspark.sql import functions as F

from epochal.operators import metrics, votes
from epochal.plans.registry import query
from epochal.sources import tables as t

K = 5
MATRIX = t.PAIRS + """, cells AS (SELECT CAST(i // 5 AS INTEGER) AS truth, CAST(i % 5 AS INTEGER) AS pred FROM (SELECT unnest(range(25)) AS i)),
counts AS (SELECT truth, pred, count(*) AS n FROM pairs GROUP BY 1, 2),
matrix AS (SELECT truth, pred, coalesce(n, 0) AS n FROM cells LEFT JOIN counts USING (truth, pred))"""
PER = """, tp AS (SELECT truth AS class, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS tp, sum(n) AS rel FROM matrix GROUP BY 1),
sel AS (SELECT pred AS class, sum(n) AS sel FROM matrix GROUP BY 1),
ratios AS (SELECT class, coalesce(tp / nullif(CAST(sel AS DOUBLE), 0), 0) AS p, coalesce(tp / nullif(CAST(rel AS DOUBLE), 0), 0) AS r FROM tp JOIN sel USING (class)),
per AS (SELECT CAST(class AS VARCHAR) AS class, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM ratios)"""
STUDY = t.PAIRS + """, totals AS (SELECT study_id, count(*) AS n FROM pairs GROUP BY 1),
grid AS (SELECT study_id, n, CAST(c AS INTEGER) AS class FROM totals, (SELECT unnest(range(5)) AS c)),
per AS (SELECT g.study_id, g.class, g.n, count(*) FILTER (WHERE truth = g.class AND pred = g.class) AS tp, count(*) FILTER (WHERE truth = g.class) AS rel, count(*) FILTER (WHERE pred = g.class) AS sel
FROM grid g JOIN pairs p ON p.study_id = g.study_id GROUP BY 1, 2, 3)"""
F1 = STUDY + """, f AS (SELECT study_id, class, coalesce(2.0 * tp / nullif(CAST(rel + sel AS DOUBLE), 0), 1) AS f1 FROM per),
study_f1 AS (SELECT * FROM f UNION ALL SELECT study_id, CAST(-1 AS INTEGER), avg(f1) FROM f GROUP BY 1)"""


def rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {MATRIX} SELECT truth, pred, CAST(n AS BIGINT) AS n FROM matrix")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(t.pairs(spark, sf_dir), K)


@query(f"WITH {MATRIX} SELECT truth, pred, round(coalesce(n / nullif(CAST(sum(n) OVER (PARTITION BY truth) AS DOUBLE), 0), 0), 9) AS share FROM matrix")
def confusion_normalized(spark, sf_dir):
    return rounded(metrics.normalised(metrics.confusion(t.pairs(spark, sf_dir), K)), "share")


@query(f"WITH {MATRIX}{PER}, rows AS (SELECT * FROM per UNION ALL SELECT 'mean', avg(p), avg(r), avg(f) FROM per) SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM rows")
def class_report(spark, sf_dir):
    return rounded(metrics.report(metrics.confusion(t.pairs(spark, sf_dir), K)), "precision", "recall", "f1")


@query("""SELECT truth, pred, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT CAST(i // 2 AS INTEGER) AS truth, CAST(i % 2 AS INTEGER) AS pred FROM (SELECT unnest(range(4)) AS i))
LEFT JOIN (SELECT quality AS truth, toxic AS pred, count(*) AS n FROM labels GROUP BY 1, 2) USING (truth, pred)""")
def binary_confusion(spark, sf_dir):
    return metrics.confusion(t.table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("pred")), 2)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS DOUBLE), 9) AS share FROM lineitem GROUP BY 1, 2")
def volume_confusion(spark, sf_dir):
    counts = t.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    shares = metrics.normalised(counts.select(F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("pred"), "n"))
    return counts.join(rounded(shares, "share"), (F.col("truth") == F.col("l_returnflag")) & (F.col("pred") == F.col("l_linestatus"))).drop("truth", "pred")


@query(f"WITH {t.VOTES} SELECT voter, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM votes GROUP BY 1")
def accuracy(spark, sf_dir):
    return rounded(metrics.accuracy(t.votes(spark, sf_dir), "voter"), "accuracy")


@query(f"""WITH {t.PAIRS}, sides AS (SELECT truth AS class, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp, 1 AS rel, 0 AS sel FROM pairs UNION ALL SELECT pred, 0, 0, 1 FROM pairs),
per AS (SELECT class, sum(tp) AS tp, sum(rel) AS rel, sum(sel) AS sel FROM sides GROUP BY 1)
SELECT round(avg(coalesce(2.0 * tp / nullif(CAST(rel + sel AS DOUBLE), 0), 0)), 9) AS macro_f1, round(2.0 * sum(tp) / CAST(sum(rel) + sum(sel) AS DOUBLE), 9) AS micro_f1 FROM per""")
def f1_macro_micro(spark, sf_dir):
    return rounded(metrics.macro_micro_f1(t.pairs(spark, sf_dir)), "macro_f1", "micro_f1")


@query(f"""WITH {t.VOTES}, sides AS (SELECT voter, truth AS class, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp, 1 AS rel, 0 AS sel FROM votes UNION ALL SELECT voter, pred, 0, 0, 1 FROM votes),
per AS (SELECT voter, class, sum(tp) AS tp, sum(rel) AS rel, sum(sel) AS sel FROM sides GROUP BY 1, 2),
sums AS (SELECT voter, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(rel) AS DOUBLE) AS n, sum(CAST(rel AS DOUBLE) * sel) AS x FROM per GROUP BY 1)
SELECT voter, round((tp / n - x / (n * n)) / nullif(1 - x / (n * n), 0), 9) AS kappa FROM sums""")
def kappa(spark, sf_dir):
    return rounded(metrics.kappa(t.votes(spark, sf_dir), "voter"), "kappa")


@query(f"""WITH {STUDY}, k AS (SELECT study_id, class, rel + sel AS present, (n - rel - sel + 2 * tp) / CAST(n AS DOUBLE) AS po,
(CAST(rel AS DOUBLE) * sel + CAST(n - rel AS DOUBLE) * (n - sel)) / (CAST(n AS DOUBLE) * n) AS pe FROM per)
SELECT study_id, class, CASE WHEN present > 0 THEN round((po - pe) / nullif(1 - pe, 0), 9) END AS kappa FROM k""")
def class_kappa(spark, sf_dir):
    return rounded(metrics.class_kappa(t.pairs(spark, sf_dir), K), "kappa")


@query(f"WITH {F1} SELECT study_id, class, round(f1, 9) AS f1 FROM study_f1")
def study_f1(spark, sf_dir):
    return rounded(metrics.study_f1(t.pairs(spark, sf_dir), K), "f1")


@query(f"WITH {F1} SELECT class, round(avg(f1), 9) AS f1 FROM study_f1 GROUP BY 1")
def grand_mean(spark, sf_dir):
    return rounded(metrics.grand_mean(metrics.study_f1(t.pairs(spark, sf_dir), K), "f1"), "f1")


@query(f"WITH {F1} SELECT class, round(avg(f1), 9) AS mean, round(stddev_samp(f1), 9) AS std, round(min(f1), 9) AS min, round(max(f1), 9) AS max FROM study_f1 WHERE study_id <> 1 GROUP BY 1")
def eval_summary(spark, sf_dir):
    return rounded(metrics.summary(metrics.study_f1(t.pairs(spark, sf_dir), K), "f1", ["1"]), "mean", "std", "min", "max")


@query(f"""WITH {t.PERIODS}, counts AS (SELECT study_id, stage, count(*) AS n FROM periods GROUP BY 1, 2 UNION ALL SELECT -1, stage, count(*) FROM periods GROUP BY 2)
SELECT study_id, stage, n, round(n / CAST(sum(n) OVER (PARTITION BY study_id) AS DOUBLE), 9) AS frequency FROM counts""")
def class_frequencies(spark, sf_dir):
    by_study = metrics.class_counts(t.periods(spark, sf_dir), "study_id").filter("study_id is not null")
    every = metrics.class_counts(t.periods(spark, sf_dir)).select(F.lit(-1).cast("long").alias("study_id"), "stage", "n", "frequency")
    return rounded(by_study.unionByName(every), "frequency")


COUNTERS = t.VOTES + """, sides AS (SELECT voter AS dataset, truth AS class, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp, 1 AS rel, 0 AS sel FROM votes UNION ALL SELECT voter, pred, 0, 0, 1 FROM votes),
counters AS (SELECT dataset, class, sum(tp) AS tp, sum(rel) AS rel, sum(sel) AS sel FROM sides GROUP BY 1, 2)"""


@query(f"WITH {COUNTERS} SELECT dataset, class, CAST(tp AS BIGINT) AS tp, CAST(rel AS BIGINT) AS relevant, CAST(sel AS BIGINT) AS selected FROM counters")
def val_counters(spark, sf_dir):
    return metrics.counters(t.votes(spark, sf_dir).withColumnRenamed("voter", "dataset"), "dataset")


@query(f"""WITH {COUNTERS}, dice AS (SELECT dataset, coalesce(2.0 * tp / nullif(CAST(rel + sel AS DOUBLE), 0), 0) AS d FROM counters),
means AS (SELECT dataset, avg(d) AS d FROM dice GROUP BY 1) SELECT CAST(dataset AS VARCHAR) AS dataset, round(d, 9) AS dice FROM means UNION ALL SELECT 'mean', round(avg(d), 9) FROM means""")
def mean_of_study_metrics(spark, sf_dir):
    """Mean over classes per dataset, and the mean of these."""
    per = metrics.counters(t.votes(spark, sf_dir).withColumnRenamed("voter", "dataset"), "dataset")
    means = per.groupBy("dataset").agg(F.avg(metrics.ratio(2 * F.col("tp"), F.col("relevant") + F.col("selected"))).alias("dice"))
    named = means.select(F.col("dataset").cast("string").alias("dataset"), "dice")
    return rounded(named.unionByName(named.agg(F.lit("mean").alias("dataset"), F.avg("dice").alias("dice"))), "dice")


@query("""WITH x AS (SELECT vec_id, label, i AS class, CAST(embedding[i + 1] AS DOUBLE) AS y, CASE WHEN label = i THEN 1.0 ELSE 0.0 END AS t FROM embeddings, (SELECT unnest(range(64)) AS i)),
per AS (SELECT vec_id, class, sum(t * y) AS ty, sum(t + y) AS b FROM x GROUP BY 1, 2) SELECT vec_id, round(1 - avg((2 * ty + 1) / (b + 1)), 6) AS loss FROM per GROUP BY 1""")
def dice_loss(spark, sf_dir):
    rows = t.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("class", "y"))
    return rounded(metrics.dice_loss(rows.withColumn("t", (F.col("label") == F.col("class")).cast("double")), "vec_id"), "loss", digits=6)


@query("SELECT source AS dataset, round(0.5 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) + 0.5 / count(*) OVER (), 9) AS p FROM documents GROUP BY 1")
def dataset_prob(spark, sf_dir):
    sizes = t.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("dataset")).agg(F.count("*").alias("n"))
    return rounded(metrics.sampling_probability(sizes), "p")


@query(f"WITH {t.VOTES}, c AS (SELECT study_id, period_idx, pred, count(*) AS n FROM votes GROUP BY 1, 2, 3) SELECT study_id, period_idx, pred FROM (SELECT *, row_number() OVER (PARTITION BY study_id, period_idx ORDER BY n DESC, pred) AS r FROM c) WHERE r = 1")
def hard_vote(spark, sf_dir):
    return votes.hard(t.votes(spark, sf_dir), "study_id", "period_idx")


SCORES = "scores AS (SELECT vec_id, CAST(i // 16 AS INTEGER) AS channel, CAST(i % 16 AS INTEGER) AS class, CAST(embedding[i + 1] AS DOUBLE) AS score FROM embeddings, (SELECT unnest(range(64)) AS i))"


@query(f"WITH {SCORES} SELECT vec_id, class, round(avg(score), 6) AS score FROM scores GROUP BY 1, 2")
def soft_vote_mean(spark, sf_dir):
    return rounded(votes.combined(t.scores(spark, sf_dir), "mean", "vec_id"), "score", digits=6)


@query(f"WITH {SCORES}, s AS (SELECT vec_id, class, round(sum(score), 6) AS score FROM scores GROUP BY 1, 2) SELECT vec_id, class AS pred FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS r FROM s) WHERE r = 1")
def soft_vote_sum(spark, sf_dir):
    return votes.winner(votes.combined(t.scores(spark, sf_dir), "sum", "vec_id"), "vec_id", digits=6)


@query(f"WITH {SCORES} SELECT vec_id, class AS period, round(sum(score) / 1 + avg(score), 6) AS score FROM scores GROUP BY 1, 2")
def augmented_vote(spark, sf_dir):
    """Base scores (the channels' sum) plus the mean of augmented ones (each channel as one)."""
    per = votes.combined(t.scores(spark, sf_dir), "sum", "vec_id").join(votes.combined(t.scores(spark, sf_dir), "mean", "vec_id").withColumnRenamed("score", "aug"), ["vec_id", "class"])
    return rounded(per.select("vec_id", F.col("class").alias("period"), (F.col("score") + F.col("aug")).alias("score")), "score", digits=6)


@query(f"""WITH {t.PERIODS}, w AS (SELECT study_id, period_idx AS start, o FROM periods, (SELECT unnest(range(5)) AS o)), sized AS (SELECT study_id, count(*) AS n FROM periods GROUP BY 1),
placed AS (SELECT w.study_id, start + o AS period_idx, CAST((start * 7 + o) % 5 AS INTEGER) AS class, 1 + o AS score FROM w JOIN sized USING (study_id) WHERE start + 5 <= n)
SELECT study_id, CAST(period_idx AS INTEGER) AS period_idx, class, CAST(sum(score) AS BIGINT) AS score FROM placed GROUP BY 1, 2, 3""")
def overlap_add(spark, sf_dir):
    from epochal.operators import windows

    starts = windows.sliding(t.periods(spark, sf_dir), 5, "stage").select("study_id", "start", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("offset"))
    scored = starts.withColumn("class", ((F.col("start") * 7 + F.col("offset")) % 5).cast("int")).withColumn("score", 1 + F.col("offset"))
    return votes.overlap_added(scored)


@query(f"WITH {t.PERIODS} SELECT study_id, CAST(period_idx * 3 + j AS INTEGER) AS sub_idx, stage FROM periods, (SELECT unnest(range(3)) AS j)")
def label_repeat(spark, sf_dir):
    return votes.repeated(t.periods(spark, sf_dir), 3)


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax(spark, sf_dir):
    return t.table(spark, sf_dir, "embeddings").select("vec_id", votes.argmax(F.col("embedding")).alias("best"))
