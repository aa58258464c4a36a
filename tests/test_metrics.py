"""The published confusion matrix and the rules for undefined values."""

import pytest

from epochal.operators import labels, metrics, splits, windows

GOLDEN = [(0, 0, 17, 234, 0), (0, 0, 132, 146, 0), (0, 0, 790, 157, 0), (0, 0, 25, 189, 0), (0, 0, 243, 99, 0)]


def pairs(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "study_id long, period_idx int, truth int, pred int")


def test_golden_report(spark):
    cells = [(i, j, n) for i, row in enumerate(GOLDEN) for j, n in enumerate(row)]
    got = {r["class"]: r for r in metrics.report(spark.createDataFrame(cells, "truth int, pred int, n long")).collect()}
    as_shown = lambda c: tuple(round(got[c][k], 2) for k in ("f1", "precision", "recall"))
    assert as_shown("2") == (0.73, 0.65, 0.83)
    assert as_shown("3") == (0.36, 0.23, 0.88)
    assert as_shown("0") == (0, 0, 0)
    assert as_shown("mean") == (0.22, 0.18, 0.34)


def test_absent_class(spark):
    p = pairs(spark, [(0, 0), (1, 1), (1, 0)])
    assert {r["class"]: r.f1 for r in metrics.report(metrics.confusion(p, 3)).collect()}["2"] == 0
    assert {r["class"]: r.f1 for r in metrics.study_f1(p, 3).collect()}[2] == 1
    assert {r["class"]: r.kappa for r in metrics.class_kappa(p, 3).collect()}[2] is None


def test_single_class_has_no_kappa(spark):
    assert metrics.kappa(pairs(spark, [(1, 1), (1, 1)])).first().kappa is None


def test_ignored_and_out_of_range(spark):
    p = pairs(spark, [(0, 0), (5, 1), (-1, 0), (1, 4)])
    assert metrics.in_range(p, 5).count() == 2
    assert sum(r.n for r in metrics.confusion(p, 5, ignore=[4]).collect()) == 1


def study(spark, stages, study_id=1):
    return spark.createDataFrame([(study_id, i, s) for i, s in enumerate(stages)], "study_id long, period_idx int, stage int")


@pytest.mark.parametrize(("stages", "around", "left"), [([0, 0, 0], 1, []), ([0, 0, 1, 2, 0, 0], 1, [1, 2, 3]), ([1, 0], 9, [0, 1]), ([0, 1, 0], 0, [])])
def test_wake_trim(spark, stages, around, left):
    assert sorted(r.period_idx for r in labels.wake_trimmed(study(spark, stages), around).collect()) == left


def test_runs_and_back(spark):
    s = study(spark, [0, 0, 1, 1, 1, 0])
    sparse = labels.run_lengths(s, 30)
    assert sorted((r.init_sec, r.duration_sec, r.stage) for r in sparse.collect()) == [(0, 60, 0), (60, 90, 1), (150, 30, 0)]
    assert sorted(map(tuple, labels.densified(sparse, 30).collect())) == sorted(map(tuple, s.collect()))


def test_gaps_and_overlaps(spark):
    kinds = "study_id long, init_sec int, duration_sec int, stage int"
    gap = labels.with_gaps(spark.createDataFrame([(1, 0, 30, 0), (1, 90, 30, 1)], kinds), 5)
    assert (1, 30, 60, 5) in set(map(tuple, gap.collect()))
    with pytest.raises(Exception, match="overlap"):
        labels.with_gaps(spark.createDataFrame([(1, 0, 60, 0), (1, 30, 30, 1)], kinds), 5).collect()


def test_margin_windows(spark):
    assert windows.margin_windows(study(spark, [0] * 4), 2, "stage").count() == 0  # shorter than a window
    got = windows.margin_windows(study(spark, list(range(5))), 2, "stage").collect()
    assert len(got) == 25 and {r.stage for r in got if r.center == 0} == set(range(5))


def test_split_sizes():
    assert splits.sizes(10, 0.15, 0.1) == (7, 1, 2)
    assert splits.sizes(10, 0.5, 0.1, most_test=2) == (7, 1, 2)
    with pytest.raises(ValueError, match="none to train"):
        splits.sizes(2, 0.5, 0.5)


def test_folds_differ_by_one(spark):
    got = splits.folds(spark.range(11).withColumnRenamed("id", "s"), "s", 4).groupBy("fold").count().collect()
    assert [r["count"] for r in sorted(got)] == [3, 3, 3, 2]


def test_names(spark):
    df = spark.createDataFrame([("SC4801G0-PSG",), ("SC4802G0-PSG",), ("SC4711E0-PSG",)], "name string")
    got = {r.group: r.names for r in splits.grouped_names(df, "name", r"SC4(\d{2}).*").collect()}
    assert got == {"80": ["SC4801G0-PSG", "SC4802G0-PSG"], "71": ["SC4711E0-PSG"]}
    with pytest.raises(Exception, match="not exactly one"):
        splits.grouped_names(spark.createDataFrame([("none",)], "name string"), "name", r"SC4(\d{2}).*").collect()


def test_channel_combinations():
    assert splits.channel_combinations([["a", "b"], ["b", "a"]]) == [["a", "b"], ["a", "a"], ["b", "b"]]
