"""Training jobs, as far as SQL can follow them: on integers."""

from pyspark.sql import functions as F

from epochal.operators import fitting
from epochal.plans.registry import query
from epochal.sources import tables as t
from epochal.sources.shared import new_path

CLASSES = 4


def _epoch(k: int) -> str:
    """Parameters after epoch k, from those before."""
    scores = f"s{k} AS (SELECT v, c, coalesce(sum(q * w), 0) AS s FROM x JOIN w{k - 1} USING (j) GROUP BY v, c), p{k} AS (SELECT v, arg_min(c, (-s, c)) AS pred FROM s{k} GROUP BY v),"
    moves = f"m{k} AS (SELECT y AS c, j, q FROM x JOIN p{k} USING (v) WHERE y <> pred UNION ALL SELECT pred, j, -q FROM x JOIN p{k} USING (v) WHERE y <> pred),"
    return f"{scores} {moves} w{k} AS (SELECT c, j, CAST(w + coalesce((SELECT sum(q) FROM m{k} WHERE m{k}.c = w{k - 1}.c AND m{k}.j = w{k - 1}.j), 0) AS BIGINT) AS w FROM w{k - 1})"


@query(f"""WITH x AS (SELECT vec_id AS v, label % {CLASSES} AS y, j, CAST(floor(256 * CAST(embedding[j + 1] AS DOUBLE)) AS BIGINT) AS q FROM embeddings, (SELECT unnest(range(64)) AS j)),
w0 AS (SELECT c, j, 0 AS w FROM (SELECT unnest(range({CLASSES})) AS c), (SELECT unnest(range(64)) AS j)), {_epoch(1)}, {_epoch(2)}
SELECT CAST(k AS INTEGER) AS epoch, CAST(c AS INTEGER) AS class, CAST(j AS INTEGER) AS feature, w AS weight FROM (SELECT 1 AS k, * FROM w1 UNION ALL SELECT 2, * FROM w2)""")
def training_epochs(spark, sf_dir):
    """Two epochs of a perceptron; the second by a run that was stopped after the first."""
    q = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x))
    rows = t.table(spark, sf_dir, "embeddings").select(q.alias("x"), (F.col("label") % CLASSES).alias("y"))
    folder, model = new_path(spark, "fit"), fitting.Perceptron(CLASSES, 64)
    fitting.fit(rows, model, folder, 1)
    made = fitting.fit(rows, model, folder, 2).parameters()
    return made.select("epoch", F.expr("at div 64").cast("int").alias("class"), (F.col("at") % 64).alias("feature"), F.col("whole").alias("weight"))
