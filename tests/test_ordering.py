"""Numbers and sums along orders, permutations, and what is drawn by them; and their plans."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import ordering, sampling, windows
from epochal.sources import tables
from tests import oracle


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "double"])
def test_running_by_number(spark, kind):
    """Sums along the key, for skewed keys and nulls, which come first."""
    rng = np.random.default_rng(0)
    keys = [None, *map(float, np.unique(np.floor(np.exp(rng.uniform(0, 20, 700)))))]
    rows = [(k, int(v)) for k, v in zip(keys, rng.integers(0, 9, len(keys)))]
    df = spark.createDataFrame(rows, "k double, v long").withColumn("k", F.col("k").cast(kind)).repartition(5)
    got = {r.k: (r.s, r.s_total) for r in ordering.running_by_number(df, "s", F.col("v"), "k").collect()}
    so_far = 0
    for k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        so_far += v
        assert got[k] == (so_far, sum(v for _, v in rows))
    assert ordering.running_by_number(df.limit(0), "s", F.col("v"), "k").count() == 0


def test_numbered_by_digest(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 3).repartition(7)
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    got = ordering.numbered_by_digest(df, "nth", digest, "g").withColumn("d", digest).collect()
    for g in range(3):
        rows = sorted((r for r in got if r.g == g), key=lambda r: r.d)
        assert [r.nth for r in rows] == list(range(1, len(rows) + 1)) and {r.nth_total for r in rows} == {len(rows)}
    whole = ordering.numbered_by_digest(df, "nth", digest)
    assert sorted(r.nth for r in whole.collect()) == list(range(1, 2001))
    assert "SinglePartition" not in plan(ordering.numbered_by_digest(df, "nth", digest, "g"))


def test_nothing_is_written_or_sorted_by_range(spark):
    sizes = windows.study_sizes(tables.periods(spark, oracle.DATA))
    for df in (windows.cumulative(sizes, 2), ordering.numbered_by_digest(spark.range(100), "nth", F.md5(F.col("id").cast("string").cast("binary")))):
        assert "rangepartitioning" not in plan(df) and "WriteFiles" not in plan(df)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1013])
def test_permuted(spark, n):
    got = [r.w for r in spark.range(n).select(ordering.permuted(F.col("id"), n, "a").alias("w")).collect()]
    assert sorted(got) == list(range(n))
    other = [r.w for r in spark.range(n).select(ordering.permuted(F.col("id"), n, "b").alias("w")).collect()]
    assert n < 100 or (got != other and np.abs(np.corrcoef(range(n), got)[0, 1]) < 0.3)


def test_epoch_order(spark):
    """Every window once, whatever the readers; a reader's slice is the same by itself."""
    sizes = spark.createDataFrame([(s, n) for s, n in enumerate([3, 4, 5, 5, 100, 1, 1000, 7])], "study_id long, n long")
    whole = windows.epoch_order(sizes, 2, "e", 6)
    rows = [tuple(r) for r in whole.collect()]
    want = Counter((s, c) for s, n in enumerate([3, 4, 5, 5, 100, 1, 1000, 7]) for c in range(2, n - 2))
    assert Counter((s, c) for _, _, s, c in rows) == want
    assert sorted(p for _, p, _, _ in rows) == list(range(len(rows)))
    per = Counter(r for r, *_ in rows)
    assert set(per) == set(range(6)) and max(per.values()) - min(per.values()) <= 1
    for reader in (0, 3, 5):
        assert sorted(map(tuple, windows.epoch_order(sizes, 2, "e", 6, reader).collect())) == sorted(r for r in rows if r[0] == reader)
    assert "rangepartitioning" not in plan(whole)
    assert windows.epoch_order(sizes.filter("n < 5"), 2, "e", 6).count() == 0


def test_weighted_windows(spark):
    """Datasets, classes, studies and periods come by their weights; windows stay inside; an absent class is an error."""
    rng = np.random.default_rng(0)
    rows = [(f"d{s % 2}", s, i, int(rng.integers(0, 3))) for s in range(10) for i in range(40 if s else 4)]
    periods = spark.createDataFrame(rows, "dataset string, study_id long, period_idx int, stage int")
    prob = spark.createDataFrame([("d0", 0.25), ("d1", 0.75)], "dataset string, p double")
    got = sampling.weighted_windows(periods, prob, {0: 1, 2: 3}, 4000, 2, 5).collect()
    stage = {(s, i): c for _, s, i, c in rows}
    by_draw = {}
    for r in got:
        by_draw.setdefault(r.draw, []).append(r)
    assert len(by_draw) == 4000 and all(sorted(r.offset for r in v) == list(range(5)) for v in by_draw.values())
    for v in by_draw.values():
        r = v[0]
        begin = min(max(r.center - 2, 0), 35)
        assert all(x.stage == stage[x.study_id, begin + x.offset] for x in v)
        assert any(stage.get((r.study_id, r.center - j)) == r["class"] for j in range(-2, 3))
    first = [v[0] for v in by_draw.values()]
    assert abs(np.mean([r.dataset == "d1" for r in first]) - 0.75) < 0.03 and abs(np.mean([r["class"] == 2 for r in first]) - 0.75) < 0.03
    counts = Counter(r.study_id for r in first if r.dataset == "d1")
    assert 0 not in Counter(r.study_id for r in first) and max(counts.values()) < 1.3 * min(counts.values())
    with pytest.raises(Exception, match="no study of d[01] has class 7"):
        sampling.weighted_windows(periods, prob, {0: 1, 7: 1}, 50, 2, 5).collect()
