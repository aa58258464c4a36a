"""Operators that SQL can't express, and the edges of those that it can."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import augment, registry, sampling, segment, signals, training


def samples(spark, values, key=1):
    return spark.createDataFrame([(key, i, float(x)) for i, x in enumerate(values)], "k long, idx int, x double")


def xs(df):
    return [r.x for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("how", ["robust", "standard", "minmax", "maxabs", "quantile"])
def test_constant_channel(spark, how):
    got = xs(signals.scaled(samples(spark, [3, 3, 3]), how, "k"))
    assert got == [1.0] * 3 if how == "maxabs" else got == [0.0] * 3


def test_trims_and_rates(spark):
    s = samples(spark, range(10))
    assert xs(signals.lead_trimmed(s, 4)) == [4, 5, 6, 7, 8, 9]
    assert xs(signals.whole_seconds(s, 4, "k")) == list(range(8))
    assert xs(signals.decimated(samples(spark, range(8)), 4, "k")) == [1.5, 5.5]
    assert xs(signals.interpolated(samples(spark, [0, 2]), 2, "k")) == [0, 1, 2, 2]


def test_regions(spark):
    assert xs(signals.flipped(samples(spark, [1, 2, 3, 4]), 3, 2, 4)) == [-1, 2, 3, -4]
    assert xs(signals.mixed(samples(spark, [0, 10, 20, 30]), 0, 2, 2, 4, "k")) == [10, 20, 20, 30]


def test_montage_needs_channels(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.5])], "a array<double>, b array<double>")
    assert signals.montage(df, {"d": ("a", "b")}).first().d == [0.5, 1.5]
    with pytest.raises(ValueError, match="needs the channels"):
        signals.montage(df, {"d": ("a", "c")})
    assert signals.montage(df, {"d": ("a", "c")}, missing_ok=True).columns == ["a", "b"]


def test_filters(spark):
    rate, n = 100, 400
    tone = lambda f: [math.sin(2 * math.pi * f * i / rate) for i in range(n)]
    power = lambda v: float(np.mean(np.square(v[200:])))
    taps = signals.band_pass_taps(rate, 5, 15, 61)
    assert power(xs(signals.filtered(samples(spark, tone(10)), taps, "k"))) > 0.4
    assert power(xs(signals.filtered(samples(spark, tone(30)), taps, "k"))) < 0.01
    assert power(xs(signals.notch(samples(spark, tone(20)), rate, 20, 5, "k"))) < 0.01
    assert power(xs(signals.notch(samples(spark, tone(5)), rate, 20, 5, "k"))) > 0.4
    with pytest.raises(ValueError):
        signals.band_pass_taps(rate, 60, 70, 61)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 1000])
def test_recursion_by_sample(n):
    x, b, a = np.random.default_rng(n).normal(size=n), (0.9, -1.2, 0.7), (-1.2, 0.8)
    want = [0.0, 0.0]
    before = [0.0, 0.0, *x]
    for i in range(n):
        want.append(b[0] * before[i + 2] + b[1] * before[i + 1] + b[2] * before[i] - a[0] * want[-1] - a[1] * want[-2])
    np.testing.assert_allclose(signals.recursed(x, b, a), want[2:], rtol=1e-9, atol=1e-12)


def test_recursion_gap():
    x = np.ones(50)
    x[20] = np.nan
    assert np.isnan(signals.recursed(x, (1, 0, 0), (-0.5, 0.2))).tolist() == [False] * 20 + [True] * 30


def test_registry(spark):
    steps = [{"name": "clip_noisy_values", "min_max_times_global_iqr": 1.0, "key": ["k"]}, {"name": "MinMaxScaler", "key": ["k"]}]
    got = xs(registry.applied(samples(spark, [0, 1, 2, 3, 100]), steps))
    assert got == [0, 0.5, 1, 1, 1]
    with pytest.raises(ValueError, match="no operators named"):
        registry.applied(samples(spark, [0]), [{"name": "nothing"}])
    with pytest.raises(ValueError, match="taken"):
        registry.register("wake_trim", lambda df: df)


def test_samplers(spark):
    rows = spark.createDataFrame([(s, i, i % 3) for s in range(6) for i in range(5 + s)], "study_id long, period_idx int, stage int")
    drawn = sampling.random_periods(rows, 300, 1).collect()
    assert len(drawn) == 300 and {r.study_id for r in drawn} == set(range(6)) and all(0 <= r.period_idx < 5 + r.study_id for r in drawn)
    counts = {r.stage: r["count"] for r in sampling.balanced_periods(rows, 7, 1).groupBy("stage").count().collect()}
    assert counts == {0: 7, 1: 7, 2: 7}
    shares = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "dataset string, p double")
    got = {r.dataset: r["count"] for r in sampling.mixed_batches(shares, 5000, 3).groupBy("dataset").count().collect()}
    assert sum(got.values()) == 5000 and abs(got["a"] - 3500) < 150 and abs(got["c"] - 500) < 100


def test_augmenters(spark):
    df = spark.createDataFrame([(i, [float(j) for j in range(8)], 1.0) for i in range(200)], "k long, x array<double>, weight double")
    same = augment.drawn(df, "k", "x", lambda x: augment.amplitude(x, 2.0), 0.0, 1)
    assert same.filter("weight <> 1").count() == 0 and same.filter("array_max(x) <> 7").count() == 0
    half = augment.drawn(df, "k", "x", lambda x: augment.shift(x, 1.0), 0.5, 1, 0.5)
    assert 60 < half.filter("weight = 0.5 and array_max(x) = 8").count() < 140 and half.filter("weight = 0.5 and array_max(x) = 7").count() == 0
    a, b = (augment.elastic(df.repartition(n), "k", "x", 1.0, 2.0, 1).orderBy("k").collect() for n in (2, 5))
    assert a == b
    noise = augment.noisy_region(df, "k", "x", 1.0, 0.25, 0.5, 1).first().x
    assert 2 <= sum(v != i for i, v in enumerate(noise)) <= 4
    with pytest.raises(ValueError, match="all channels"):
        augment.channel_dropout(["a"], "k", 0.5, 1)


def test_training_tables(spark):
    files = spark.createDataFrame([("@epoch_3_loss_0.20.h5",), ("@epoch_11_val_loss_0.30.h5",), ("@epoch_9_val_loss_0.25.h5",)], "file string")
    assert training.best_model(files).first().file == "@epoch_9_val_loss_0.25.h5"
    assert training.last_model(files).first().file == "@epoch_11_val_loss_0.30.h5"
    plain = spark.createDataFrame([("@epoch_3_loss_0.20.h5",), ("@epoch_4_loss_0.10.h5",)], "file string")
    assert training.best_model(plain).first().file == "@epoch_4_loss_0.10.h5"


@pytest.mark.parametrize("backwards", [False, True])
def test_best_model_of_equally_good_ones(spark, backwards):
    names = sorted(["@epoch_10_val_dice_0.90.h5", "@epoch_9_val_dice_0.90.h5", "@epoch_30_val_dice_0.90.h5", "@epoch_1_val_dice_0.20.h5"], reverse=backwards)
    files = spark.createDataFrame([(x,) for x in names], "file string").coalesce(1)
    assert training.best_model(files).first().file == "@epoch_9_val_dice_0.90.h5"
    losses = files.select(F.replace("file", F.lit("dice"), F.lit("loss")).alias("file")).filter("file not like '%0.20%'")
    assert training.best_model(losses).first().file == "@epoch_9_val_loss_0.90.h5"


def test_softmax_is_linear(spark):
    """The largest score and the sum are found once a row, not once an element: 64 times 512 elements took minutes."""
    import time

    from epochal.functions import scalars

    xs = np.random.default_rng(0).normal(size=(64, 512))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "i int, x array<double>").coalesce(1)
    began = time.time()
    got = np.array([r.p for r in df.orderBy("i").select(scalars.softmax(F.col("x")).alias("p")).collect()])
    assert time.time() - began < 30
    want = np.exp(xs - xs.max(axis=1, keepdims=True))
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True), rtol=1e-12)
    odd = spark.createDataFrame([(None,), ([],), ([1.0],), ([0.0, None],)], "x array<double>")
    assert [r.p for r in odd.select(scalars.softmax(F.col("x")).alias("p")).collect()] == [None, [], [1.0], [None, None]]


def test_top_model_with_ties(spark):
    """sf0.1 has five models of one score; the SQL in one thread takes the first row's."""
    from epochal.plans import catalogue
    from tests import oracle

    data = "/root/testdata/sf0.1"
    con = oracle.connect(data)
    con.execute("SET threads = 1")
    oracle.check(spark, con, catalogue.QUERIES["top_model"], catalogue.SQL["top_model"], data)


def test_network_is_local():
    net = segment.random_net(2, 5)
    x = np.random.default_rng(0).normal(size=(640, 2))
    one = segment.forward(x, net, 32)
    assert one.shape == (20, 5) and np.allclose(one.sum(axis=1), 1)
    y = x.copy()
    y[600:] = 0
    assert np.allclose(segment.forward(y, net, 32)[:15], one[:15])


def test_convolution():
    x, w = np.random.default_rng(0).normal(size=(9, 2)), np.random.default_rng(1).normal(size=(3, 2, 4))
    want = np.array([[sum(w[k, c, o] * (x[i + k - 1, c] if 0 <= i + k - 1 < 9 else 0) for k in range(3) for c in range(2)) for o in range(4)] for i in range(9)])
    assert np.allclose(segment.conv(x, w, np.zeros(4)), want)


def test_label_smoothing_edges(spark):
    from epochal.operators import labels

    p = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "study_id long, period_idx int, stage int")
    got = {(r.period_idx, r["class"]): round(r.weight, 6) for r in labels.smoothed(p, (0.25, 0.5, 0.25), 2).collect()}
    assert got == {(0, 0): 0.75, (0, 1): 0.25, (1, 0): 0.25, (1, 1): 0.75}


def test_pooled(spark):
    df = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0, 9.0],), ([1.0],)], "x array<double>")
    assert [r.p for r in df.select(signals.pooled(F.col("x"), 2).alias("p")).collect()] == [[2.0, 6.0], []]
