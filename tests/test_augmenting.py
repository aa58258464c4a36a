"""Augmenters, losses and metrics by name."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epochal.operators import augment, augmenting, losses, sampling
from epochal.operators.augmenting import Elements, augmented

SCHEMA = "k long, a array<double>, b array<double>, y array<int>"


def rows(spark, n=200, size=16):
    return spark.createDataFrame([(i, [float(j) for j in range(size)], [float(-j) for j in range(size)], [j // 4 for j in range(size)]) for i in range(n)], SCHEMA)


def step(name, **kwargs):
    return {"cls_name": name, "kwargs": {"apply_prob": 1.0} | kwargs}


def test_all_names_apply_without_a_shuffle(spark):
    part = {"min_region_fraction": 0.1, "max_region_fraction": 0.5}
    steps = [
        step("GlobalElasticDeformations", alpha=[1, 5], sigma=2.0), step("GlobalAmplitude", min_scaling=0.5, max_scaling=2), step("GlobalShift", min_shift=-1, max_shift=1),
        step("GlobalGaussianNoise", sigma=0.1), step("ChannelDropout", drop_fraction=0.5), step("RegionalGaussianNoise", **part), step("RegionalErase", **part),
        step("RegionalSignalMix", **part), step("RegionalSignFlip", log_sample=False, **part),
    ]
    assert {s["cls_name"] for s in steps} == set(augmenting.AUGMENTERS)
    done = augmented(rows(spark), Elements("k", ["a", "b"], "y"), steps, 3)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.columns == ["k", "a", "b", "y", "weight"]
    one, two = (augmented(rows(spark).repartition(n), Elements("k", ["a", "b"], "y"), steps, 3).orderBy("k").collect() for n in (2, 5))
    assert one == two and all(len(r.a) == 16 and all(map(math.isfinite, r.a + r.b)) for r in one)
    assert {round(r.weight, 9) for r in one} == {round(0.5**9, 9)}


def test_lengths_of_regions(spark):
    """Log-uniform lengths have a median at the geometric mean, uniform ones at the mean."""
    df = spark.range(2000).select(F.col("id").alias("k"), F.array_repeat(F.lit(1.0), 100).alias("x"))
    medians = {}
    for log in (True, False):
        length = augment.drawn_region(F.col("x"), "k", 0.01, 0.81, 1, log)[1]
        got = np.array([r[0] for r in df.select(length).collect()])
        assert got.min() >= 1 and got.max() <= 81
        medians[log] = np.median(got)
    assert abs(medians[True] - 9) <= 2 and abs(medians[False] - 41) <= 4


def test_elastic_moves_labels_with_samples(spark):
    """A ramp shows the place that each sample came from; the label is that of the nearest place."""
    done = augmented(rows(spark, 50, 32), Elements("k", ["a", "b"], "y"), [step("GlobalElasticDeformations", alpha=[5, 20], sigma=[2, 4])], 1).collect()
    moved = outside = 0
    for r in done:
        assert np.allclose(r.a, -np.array(r.b))
        for at, (p, label) in enumerate(zip(r.a, r.y)):
            if p == 0 and label == 0 and at > 3:
                outside += 1
            else:
                assert label == math.ceil(p - 0.5) // 4
                moved += p != at
    assert moved > 500 and outside > 0


def test_elastic_without_strength_changes_nothing(spark):
    before = rows(spark, 20).orderBy("k").collect()
    done = augmented(rows(spark, 20), Elements("k", ["a", "b"], "y"), [step("GlobalElasticDeformations", alpha=0, sigma=3)]).orderBy("k").collect()
    assert [r[:4] for r in done] == [tuple(r) for r in before]


def test_probability_and_weight(spark):
    done = augmented(rows(spark, 1000), Elements("k", ["a"]), [step("GlobalShift", min_shift=1, max_shift=1, apply_prob=0.25, aug_weight=0.3)], 2)
    hit = done.filter("weight = 0.3").count()
    assert 190 < hit < 310 and hit == done.filter("a[0] = 1").count() and done.filter("weight = 1 and a[0] = 0").count() == 1000 - hit
    twice = augmented(done, Elements("k", ["a"]), [step("GlobalShift", min_shift=1, max_shift=1, aug_weight=0.5)], 2)
    assert twice.filter("weight = 0.15").count() == hit


def test_odd_elements(spark):
    odd = spark.createDataFrame([(1, None, None, None), (2, [], [], []), (3, [1.0, None, 3.0], [None, None, None], [1]), (None, [1.0], [2.0], [1])], SCHEMA)
    part = {"min_region_fraction": 0.5, "max_region_fraction": 1.0}
    steps = [step("GlobalElasticDeformations", alpha=1, sigma=1), step("RegionalErase", **part), step("ChannelDropout", drop_fraction=0.5), step("RegionalSignalMix", **part)]
    got = {r.k: r for r in augmented(odd, Elements("k", ["a", "b"], "y"), steps).collect()}
    assert got[1].a is None and got[2].a == [] and len(got[3].a) == 3 and got[3].y == [1] and len(got[None].a) == 1
    assert augmented(odd.limit(0), Elements("k", ["a", "b"]), steps).count() == 0
    assert augmented(odd, Elements("k", ["a"]), None).columns == [*odd.columns, "weight"]


@pytest.mark.parametrize(
    "steps, error",
    [
        ([step("Nothing")], "no augmenters named"),
        ([step("GlobalElasticDeformations", alpha=[2, 1], sigma=1)], "two ascending numbers"),
        ([step("RegionalErase", min_region_fraction=0, max_region_fraction=0.5)], "above 0"),
        ([step("RegionalErase", min_region_fraction=0.5, max_region_fraction=1.5)], "at most 1"),
        ([step("GlobalShift", min_shift=0, max_shift=1, apply_prob=2)], "probability"),
        ([step("ChannelDropout", drop_fraction=1.0)], "all channels"),
    ],
)
def test_wrong_settings(spark, steps, error):
    with pytest.raises(ValueError, match=error):
        augmented(rows(spark, 1), Elements("k", ["a", "b"]), steps)


def test_wrong_lists(spark):
    with pytest.raises(TypeError):
        augmented(rows(spark, 1), Elements("k", ["a"]), ["GlobalShift"])


def test_measures(spark):
    data = [("g", 0, [0.7, 0.2, 0.1]), ("g", 2, [0.5, 0.3, 0.2]), ("g", 5, [1.0, 0.0, 0.0]), ("h", 1, [0.4, 0.4, 0.2]), ("h", None, [1.0, 0.0, 0.0]), ("h", 1, None)]
    df = spark.createDataFrame(data, "g string, truth int, scores array<double>")
    found = losses.measured(df, {"SparseCategoricalCrossentropy": {}, "SparseCategoricalAccuracy": {}, "SparseTopKCategoricalAccuracy": {"k": 2}, "SparseDiceLoss": {}}, ["g"], ignore_out_of_bounds=True)
    got = {(r.g, r.name): r.value for r in found.collect()}
    assert got["g", "SparseCategoricalCrossentropy"] == pytest.approx((-math.log(0.7) - math.log(0.2)) / 2)
    assert got["g", "SparseCategoricalAccuracy"] == 0.5 and got["h", "SparseCategoricalAccuracy"] == 0.0
    assert got["g", "SparseTopKCategoricalAccuracy"] == 0.5 and got["h", "SparseTopKCategoricalAccuracy"] == 1.0
    t, y = np.array([[1, 0, 0], [0, 0, 1]]), np.array([[0.7, 0.2, 0.1], [0.5, 0.3, 0.2]])
    assert got["g", "SparseDiceLoss"] == pytest.approx(1 - np.mean((2 * (t * y).sum(0) + 1) / ((t + y).sum(0) + 1)))
    assert losses.measured(df, {"SparseCategoricalCrossentropy": {}}, ["g"], "sum", True).filter("g = 'g'").first().value == pytest.approx(-math.log(0.14))
    with pytest.raises(PySparkException, match="class 5 is out of bounds"):
        losses.measured(df, {"SparseCategoricalAccuracy": {}}, ["g"]).collect()


def test_names_of_measures(spark):
    df = spark.createDataFrame([("g", 0, [1.0])], "g string, truth int, scores array<double>")
    for names, error in ((["CategoricalAccuracy"], "sparse"), (["SparseNothing"], "no loss or metric")):
        with pytest.raises(ValueError, match=error):
            losses.measured(df, {n: {} for n in names}, ["g"])
    with pytest.raises(ValueError, match="no reduction"):
        losses.measured(df, {"SparseDiceLoss": {}}, ["g"], "median")
    with pytest.raises(ValueError, match="taken"):
        losses.register("SparseDiceLoss", losses.accuracy)
    with pytest.raises(ValueError, match="sparse"):
        losses.register("Mine", losses.accuracy)


def test_samplers_by_name(spark):
    periods = spark.createDataFrame([(s, i, i % 3) for s in range(6) for i in range(12)], "study_id long, period_idx int, stage int")
    balanced = sampling.batches(periods, 8, random=True, balanced=True)
    assert {r["count"] for r in balanced.groupBy("stage").count().collect()} == {8}
    assert sampling.batches(periods, 20, random=True, balanced=False).count() == 20
    whole = sampling.batches(periods, 20, random=False, balanced=False)
    assert whole.count() == 72 and whole.groupBy("batch").count().filter("count <> 20").count() == 1
    with pytest.raises(ValueError, match="random"):
        sampling.batches(periods, 8, random=False, balanced=True)
