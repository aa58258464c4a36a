"""Scalers against numpy, and on keys and values that are odd or hot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import signals

SCHEMA = "k string, idx int, x double"


def expected(how, x):
    if how == "quantile":
        return [sum(v < w for v in x) / max(1, len(x) - 1) for w in x]
    centre, width = {
        "robust": lambda: (np.percentile(x, 50), np.percentile(x, 75) - np.percentile(x, 25)), "standard": lambda: (np.mean(x), np.std(x)),
        "minmax": lambda: (min(x), max(x) - min(x)), "maxabs": lambda: (0, max(map(abs, x))),
    }[how]()
    return (np.array(x) - centre) / (width or 1)


@pytest.mark.parametrize("how", ["robust", "standard", "minmax", "maxabs", "quantile"])
def test_scalers(spark, how):
    """A hot key of many equal values, a constant one, a single sample, and a null key."""
    draw = np.random.default_rng(1)
    data = {"hot": [float(v) for v in draw.integers(-5, 6, 3000)], "spread": draw.normal(0, 10, 500).tolist(), "flat": [3.0] * 7, "one": [2.0], None: [1.0, 2.0, 4.0]}
    df = spark.createDataFrame([(k, i, v) for k, x in data.items() for i, v in enumerate(x)], SCHEMA).repartition(7)
    done = signals.scaled(df, how, "k")
    assert done.columns == df.columns
    got = {(r.k, r.idx): r.x for r in done.collect()}
    assert len(got) == sum(map(len, data.values()))
    for k, x in data.items():
        assert np.allclose([got[k, i] for i in range(len(x))], expected(how, x))
    assert signals.scaled(df.limit(0), how, "k").count() == 0


@pytest.mark.parametrize("how", ["standard", "minmax", "maxabs"])
def test_samples_stay_where_they_are(spark, how):
    """Only partial statistics are shuffled: no window, no sort of samples."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("idx"), F.col("id").cast("double").alias("x"))
    plan = signals.scaled(df, how, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_ranks_in_ranges(spark):
    """No window over a whole key but that over one row a range; nulls rank first."""
    df = spark.createDataFrame([("a", i, None if i < 3 else float(i)) for i in range(10)], SCHEMA)
    got = {r.idx: r.x for r in signals.scaled(df, "quantile", "k").collect()}
    assert [round(got[i] * 9) for i in range(10)] == [0, 0, 0, 3, 4, 5, 6, 7, 8, 9]
