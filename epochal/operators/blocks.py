"""Filters and resampling of long records, block by block.

A record is a key's rows of a place (period_idx, from 0 without gaps) and an array of samples, all of one length but for the last. What a
block needs of its neighbours is sent to it, so blocks are grouped one by one, and a record of any length is filtered by many
tasks. Beyond a record's ends its samples are zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from epochal.operators.signals import band_pass_taps, recursed

#: Affine maps that one task composes; more are composed in levels.
SCAN = 1024


def with_halo(blocks: DataFrame, halo: int, length: int, *key: str, right: bool = True) -> DataFrame:
    """key, period_idx, wide, before, n: each block's n samples with up to halo samples before (as many as before says) and behind."""
    reach = -(-halo // length)
    pieces = []
    for j in range(-reach if right else 0, reach + 1):
        n = min(length, halo - (abs(j) - 1) * length)
        piece = F.col("samples") if j == 0 else F.expr(f"slice(samples, greatest(size(samples) - {n}, 0) + 1, {n})") if j > 0 else F.expr(f"slice(samples, 1, {n})")
        pieces.append(F.struct((F.col("period_idx") + j).alias("to"), F.lit(-j).alias("at"), piece.alias("piece")))
    sent = blocks.withColumn("samples", F.col("samples").cast("array<double>")).select(*key, F.inline(F.array(*pieces)))
    sent = sent.filter("`to` >= 0").groupBy(*key, F.col("to").alias("period_idx")).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("all"))
    size = lambda keep: F.aggregate(F.filter("all", keep), F.lit(0), lambda n, x: n + F.size(x["piece"]))
    wide = sent.select(*key, "period_idx", F.flatten(F.transform("all", lambda x: x["piece"])).alias("wide"), size(lambda x: x["at"] < 0).alias("before"), size(lambda x: x["at"] == 0).alias("n"))
    return wide.filter("n > 0")


def each_block(wide: DataFrame, make: Callable[..., np.ndarray], *more: str) -> DataFrame:
    """wide, with samples instead of wide, before and n: what make gives for the samples with before's zeros put in front, n, the
    block's place, and the columns more."""
    kept = [f for f in wide.schema.fields if f.name not in ("wide", "before", "n", *more)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = batch.column("wide"), batch.column("wide").values.to_numpy()
            at, out = rows.offsets.to_pylist(), []
            others = [batch.column(c).to_pylist() for c in ("before", "n", "period_idx", *more)]
            for i, (before, n, place, *rest) in enumerate(zip(*others)):
                out.append(make(values[at[i] : at[i + 1]], before, n, place, *rest))
            offsets = pa.array(np.cumsum([0, *map(len, out)]), pa.int32())
            samples = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*out, np.zeros(0)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), samples], [*names, "samples"])

    return wide.mapInArrow(run, StructType([*kept, StructField("samples", ArrayType(DoubleType()))]))


def padded(x: np.ndarray, before: int, n: int, halo: int) -> np.ndarray:
    """n samples with exactly halo samples on either side."""
    return np.concatenate([np.zeros(halo - before), x, np.zeros(halo - (len(x) - before - n))])


def convolved(blocks: DataFrame, taps: list[float], length: int, *key: str) -> DataFrame:
    """A finite impulse response, centred: overlap-save, a transform of each block and its halo."""
    if len(taps) % 2 == 0:
        raise ValueError("an odd number of taps is needed")
    h, middle = np.array(taps, float), len(taps) // 2

    def make(x: np.ndarray, before: int, n: int, place: int) -> np.ndarray:
        wide = padded(x, before, n, middle)
        return np.fft.irfft(np.fft.rfft(wide) * np.fft.rfft(h, len(wide)), len(wide))[2 * middle :]

    return each_block(with_halo(blocks, middle, length, *key), make)


def band_pass(blocks: DataFrame, rate: float, low: float, high: float, taps: int, length: int, *key: str) -> DataFrame:
    return convolved(blocks, band_pass_taps(rate, low, high, taps), length, *key)


def resampling_taps(up: int, down: int, zeros: int = 10) -> list[float]:
    """A low-pass at the lower of both rates' limits, as a sinc under a Hann window, that lets through a constant as it is."""
    most, half = max(up, down), zeros * max(up, down)
    h = [(1.0 if i == 0 else math.sin(math.pi * i / most) / (math.pi * i / most)) * (0.5 + 0.5 * math.cos(math.pi * i / (half + 1))) for i in range(-half, half + 1)]
    return [x * up / sum(h) for x in h]


def resampled(blocks: DataFrame, up: int, down: int, length: int, *key: str, zeros: int = 10) -> DataFrame:
    """To up / down times the rate: a bank of one short filter for each phase of an output sample between two input samples. A block
    gives the output samples whose time is in it, so a record of n samples becomes one of n * up / down, rounded up."""
    common = math.gcd(up, down)
    up, down = up // common, down // common
    h = np.array(resampling_taps(up, down, zeros))
    half = len(h) // 2
    reach = -(-half // up)
    taps = half + np.arange(up)[:, None] - np.arange(-reach, reach + 1) * up
    bank = np.where((taps >= 0) & (taps < len(h)), h[np.clip(taps, 0, len(h) - 1)], 0.0)

    def make(x: np.ndarray, before: int, n: int, place: int) -> np.ndarray:
        start = place * length
        m = np.arange(-(-start * up // down), -(-(start + n) * up // down))
        windows = np.lib.stride_tricks.sliding_window_view(padded(x, before, n, reach), 2 * reach + 1)
        return (windows[m * down // up - start] * bank[m * down % up]).sum(1)

    return each_block(with_halo(blocks, reach, length, *key), make)


def states(maps: DataFrame, *key: str) -> DataFrame:
    """key, period_idx, s: the state before each block, if the state before the first is zero and each block takes a state s to m s + v
    (m: four numbers, v: two). Affine maps compose, so runs of SCAN blocks are composed first, then runs of these, and so on."""
    last = maps.agg(F.max("period_idx")).first()[0] or 0

    def scan(frame: pd.DataFrame) -> pd.DataFrame:
        frame, s, out = frame.sort_values("period_idx"), np.zeros(2), []
        if "s" in frame:
            s = np.array(frame["s"].iloc[0])
        for m, v in zip(frame["m"], frame["v"]):
            out.append(s.tolist())
            s = np.reshape(m, (2, 2)) @ s + v
        return frame[[*key, "period_idx"]].assign(s=out)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame, a, b = frame.sort_values("period_idx"), np.eye(2), np.zeros(2)
        for m, v in zip(frame["m"], frame["v"]):
            m = np.reshape(m, (2, 2))
            a, b = m @ a, m @ b + v
        return frame[[*key, "run"]].iloc[:1].assign(m=[a.ravel().tolist()], v=[b.tolist()])

    kept = StructType([*(maps.schema[c] for c in key)])
    out = StructType([*kept.fields, maps.schema["period_idx"], StructField("s", ArrayType(DoubleType()))])
    if last < SCAN:
        return maps.groupBy(*key).applyInPandas(scan, out)
    runs = maps.withColumn("run", F.expr(f"period_idx div {SCAN}"))
    whole = StructType([*kept.fields, StructField("run", runs.schema["run"].dataType), *(maps.schema[c] for c in ("m", "v"))])
    before = states(runs.groupBy(*key, "run").applyInPandas(compose, whole).withColumnRenamed("run", "period_idx"), *key)
    return runs.join(before.withColumnRenamed("period_idx", "run"), [*key, "run"]).groupBy(*key, "run").applyInPandas(scan, out)


def biquad(blocks: DataFrame, b: tuple[float, float, float], a: tuple[float, float], length: int, *key: str) -> DataFrame:
    """A second-order recursive filter from rest: y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a0 y[n-1] - a1 y[n-2]. Each block is filtered as if
    from rest; its last two values and what it does to two values before it are an affine map. Composed, these give each block's true
    beginning, and what follows from that is added."""
    wide = with_halo(blocks, 2, length, *key, right=False)
    after = np.zeros((2, length + 2))  # the two values before, and what follows them, for (y[-1], y[-2]) = (1, 0) and (0, 1)
    after[0, 1] = after[1, 0] = 1.0
    for i in range(length):
        after[:, i + 2] = -a[0] * after[:, i + 1] - a[1] * after[:, i]

    def from_rest(x: np.ndarray, before: int, n: int) -> np.ndarray:
        x = np.concatenate([np.zeros(2 - before), x])
        return recursed(b[0] * x[2:] + b[1] * x[1:-1] + b[2] * x[:-2], (1.0, 0.0, 0.0), a)

    def ends(x: np.ndarray, before: int, n: int, place: int) -> np.ndarray:
        y = np.concatenate([np.zeros(2), from_rest(x, before, n)])
        return np.array([after[0, n + 1], after[1, n + 1], after[0, n], after[1, n], y[-1], y[-2]])

    def make(x: np.ndarray, before: int, n: int, place: int, s: list[float]) -> np.ndarray:
        return from_rest(x, before, n) + s[0] * after[0, 2 : n + 2] + s[1] * after[1, 2 : n + 2]

    maps = each_block(wide, ends).select(*key, "period_idx", F.slice("samples", 1, 4).alias("m"), F.slice("samples", 5, 2).alias("v"))
    return each_block(wide.join(states(maps, *key), [*key, "period_idx"]), make, "s")


def notch_coefficients(rate: float, freq: float, quality: float) -> tuple[tuple[float, float, float], tuple[float, float]]:
    w = 2 * math.pi * freq / rate
    alpha, c = math.sin(w) / (2 * quality), math.cos(w)
    return (1 / (1 + alpha), -2 * c / (1 + alpha), 1 / (1 + alpha)), (-2 * c / (1 + alpha), (1 - alpha) / (1 + alpha))


def notch(blocks: DataFrame, rate: float, freq: float, quality: float, length: int, *key: str) -> DataFrame:
    """Takes out one frequency."""
    return biquad(blocks, *notch_coefficients(rate, freq, quality), length, *key)
