"""Filters in blocks against filters of whole records, and their plans."""

import math

import numpy as np
import pytest

from epochal.operators import blocks, signals


def frame(spark, n=1003, length=20, keys=2, seed=0):
    x = np.random.default_rng(seed).normal(size=(keys, n)).cumsum(1)
    rows = [(k, i // length, x[k, i : i + length].tolist()) for k in range(keys) for i in range(0, n, length)]
    return x, spark.createDataFrame(rows, "key int, period_idx int, samples array<double>").repartition(7)


def joined(df, key=0):
    return np.concatenate([r.samples for r in df.filter(f"key = {key}").orderBy("period_idx").collect()])


@pytest.mark.parametrize(("taps", "n"), [(1, 100), (9, 1003), (41, 1003), (101, 1003), (101, 15)])
def test_convolved(spark, taps, n):
    """Halos within a neighbour and over several of them, at the ends too."""
    h = np.random.default_rng(taps).normal(size=taps).tolist()
    x, df = frame(spark, n)
    got = blocks.convolved(df, h, 20, "key")
    for k in range(2):
        assert np.allclose(joined(got, k), np.convolve(x[k], h, "full")[taps // 2 : taps // 2 + n])


@pytest.mark.parametrize(("up", "down", "n"), [(5, 8, 1003), (16, 25, 999), (3, 1, 200), (1, 4, 1003), (7, 3, 19), (10, 10, 45)])
def test_resampled(spark, up, down, n):
    """Like the filter of the record with zeros between its samples, of which every down-th sample is kept."""
    x, df = frame(spark, n)
    got = joined(blocks.resampled(df, up, down, 20, "key"), 1)
    g = math.gcd(up, down)
    h = np.array(blocks.resampling_taps(up // g, down // g))
    spaced = np.zeros(n * up // g)
    spaced[:: up // g] = x[1]
    want = np.convolve(spaced, h, "full")[len(h) // 2 :][: len(spaced)][:: down // g]
    assert len(got) == len(want) == -(-n * up // down)
    assert np.allclose(got, want)


def test_resampled_tone(spark):
    """200 to 128 Hz: a tone below the new limit stays, one above it goes."""
    time = np.arange(4000) / 200
    for freq, kept in ((10, True), (90, False)):
        x = np.sin(2 * np.pi * freq * time)
        df = spark.createDataFrame([(0, i // 200, x[i : i + 200].tolist()) for i in range(0, 4000, 200)], "key int, period_idx int, samples array<double>")
        y = joined(blocks.resampled(df, 128, 200, 200, "key"))[200:-200]
        want = np.sin(2 * np.pi * freq * np.arange(2560) / 128)[200:-200]
        assert np.abs(y - want).max() < 0.01 if kept else np.abs(y).max() < 0.01


@pytest.mark.parametrize(("n", "scan"), [(1003, 1024), (1003, 4), (1, 1024), (20, 3)])
def test_biquad(spark, monkeypatch, n, scan):
    """Affine maps composed in one level and in several."""
    monkeypatch.setattr(blocks, "SCAN", scan)
    b, a = blocks.notch_coefficients(128, 50, 5)
    x, df = frame(spark, n)
    got = blocks.biquad(df, b, a, 20, "key")
    for k in range(2):
        y = np.zeros(n + 2)
        u = np.concatenate([[0, 0], x[k]])
        for i in range(2, n + 2):
            y[i] = b[0] * u[i] + b[1] * u[i - 1] + b[2] * u[i - 2] - a[0] * y[i - 1] - a[1] * y[i - 2]
        assert np.allclose(joined(got, k), y[2:])


def test_no_group_holds_a_record(spark):
    """Blocks are dealt by key and place, and nothing sorts a record."""
    _, df = frame(spark)
    for made in (blocks.convolved(df, [0.25, 0.5, 0.25], 20, "key"), blocks.resampled(df, 5, 8, 20, "key")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "hashpartitioning(key" in x]
        assert dealt and all("period_idx" in x or "_groupingexpression" in x or "to#" in x for x in dealt) and "Window" not in plan
    assert blocks.convolved(df.limit(0), [1.0], 20, "key").count() == 0


def test_band_pass_and_notch_by_frequency(spark):
    time = np.arange(2560) / 128
    for freq in (10, 50):
        x = np.sin(2 * np.pi * freq * time)
        df = spark.createDataFrame([(0, i // 128, x[i : i + 128].tolist()) for i in range(0, 2560, 128)], "key int, period_idx int, samples array<float>")
        passed = np.abs(joined(blocks.band_pass(df, 128, 4, 30, 101, 128, "key"))[400:-400]).max()
        stopped = np.abs(joined(blocks.notch(df, 128, 50, 5, 128, "key"))[1000:]).max()
        assert (passed > 0.95 and stopped > 0.95) if freq == 10 else (passed < 0.05 and stopped < 0.05)
    assert signals.band_pass_taps(128, 4, 30, 41) == signals.band_pass_taps(128, 4, 30, 41)[::-1] or np.allclose(signals.band_pass_taps(128, 4, 30, 41), signals.band_pass_taps(128, 4, 30, 41)[::-1])
