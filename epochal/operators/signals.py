"""Signal preparation: derivation, clipping, scaling, trimming and resampling of long-form samples.

Samples have a key (study or record, and channel), a place idx and a value x. Statistics are per key, so every operator shuffles by
key at most once, and rows stay rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_statistics(samples: DataFrame, statistics: DataFrame, key: list[str]) -> DataFrame:
    """Samples with the statistics of their key, a null key's among them. Spark broadcasts statistics that it knows to be small, and splits
    a hot key's samples otherwise."""
    of = statistics.withColumnsRenamed({k: f"_{k}" for k in key})
    same = reduce(Column.__and__, (samples[k].eqNullSafe(of[f"_{k}"]) for k in key), F.lit(True))
    return samples.join(of, same).drop(*(f"_{k}" for k in key))


#: Centre and width of a scaler, as aggregates of a key's values.
SCALERS: dict[str, Callable[[str], tuple[Column, Column]]] = {
    "standard": lambda x: (F.avg(x), F.stddev_pop(x)),
    "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)),
    "maxabs": lambda x: (F.lit(0.0), F.max(F.abs(x))),
    "robust": lambda x: (F.percentile(x, 0.5), F.percentile(x, 0.75) - F.percentile(x, 0.25)),
}


def scaled(samples: DataFrame, how: str, *key: str, value: str = "x") -> DataFrame:
    """x scaled within its key: robust, standard, minmax, maxabs or quantile. A constant channel is centred and keeps scale 1. Statistics are
    summed in the map tasks, so no task needs a whole key's samples; exact percentiles hold a key's distinct values as counts."""
    if how == "quantile":
        return ranked(samples, *key, value=value)
    if how not in SCALERS:
        raise ValueError(f"no scaler named {how}")
    centre, width = SCALERS[how](value)
    rows = with_statistics(samples, samples.groupBy(*key).agg(centre.alias("_centre"), width.alias("_width")), [*key])
    over = F.when(F.col("_width") == 0, F.lit(1.0)).otherwise(F.col("_width"))
    return rows.withColumn(value, (F.col(value) - F.col("_centre")) / over).drop("_centre", "_width")


#: Parts of a key's values in which ranks are counted.
RANGES = 64


def ranked(samples: DataFrame, *key: str, value: str = "x") -> DataFrame:
    """x as the share of its key's other samples that are below it. Equal values meet as counts in the map tasks; the counts of a key are cut
    at its approximate percentiles and summed range by range, so a long record is no single task's. Null values come first, as in a sort."""
    counts = samples.groupBy(*key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = samples.groupBy(*key).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(-1))
    rows = with_statistics(counts, cuts, [*key]).withColumn("_part", part).drop("_cuts")
    sums = rows.groupBy(*key, "_part").agg(F.sum("_n").alias("_sum"))
    every = Window.partitionBy(*key)  # at most RANGES + 1 rows a key
    before = F.sum("_sum").over(every.orderBy("_part")) - F.col("_sum")
    sums = sums.select(*key, "_part", before.alias("_before"), F.sum("_sum").over(every).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy(*key, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    rows = with_statistics(rows.withColumn("_inside", inside), sums, [*key, "_part"])
    share = F.when(F.col("_all") > 1, (F.col("_before") + F.col("_inside")) / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    shares = rows.select(*key, F.col("_v").alias(value), share.alias("_share"))
    return with_statistics(samples, shares, [*key, value]).withColumn(value, F.col("_share")).drop("_share")


def iqr(samples: DataFrame, *key: str, value: str = "x") -> DataFrame:
    """key and iqr. Exact; the values of a key are buffered as counts."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    return samples.groupBy(*key).agg((q[1] - q[0]).alias("iqr"))


def clipped(samples: DataFrame, times: float, *key: str, value: str = "x") -> DataFrame:
    """Values beyond so many interquartile ranges of their key are set to that bound."""
    bound = F.col("iqr") * times
    return with_statistics(samples, iqr(samples, *key, value=value), [*key]).withColumn(value, F.greatest(F.least(value, bound), -bound)).drop("iqr")


def zeroed(samples: DataFrame, times: float, key: list[str], epoch: str, value: str = "x") -> DataFrame:
    """Epochs with any value beyond so many interquartile ranges become zero throughout."""
    worst = F.max(F.abs(value)).over(Window.partitionBy(*key, epoch))
    rows = with_statistics(samples, iqr(samples, *key, value=value), [*key])
    return rows.withColumn(value, F.when(worst > F.col("iqr") * times, F.lit(0.0)).otherwise(F.col(value))).drop("iqr")


def montage(wide: DataFrame, pairs: dict[str, tuple[str, str]], missing_ok: bool = False) -> DataFrame:
    """Adds derived channels a - b. Channels are array columns; a pair whose channels aren't there is an error unless allowed."""
    out = wide
    for name, (a, b) in pairs.items():
        if a in wide.columns and b in wide.columns:
            out = out.withColumn(name, F.zip_with(a, b, lambda x, y: x - y))
        elif not missing_ok:
            raise ValueError(f"{name} needs the channels {a} and {b}")
    return out


def lead_trimmed(samples: DataFrame, n: Column | int) -> DataFrame:
    """Without the first n samples; places count from 0 again."""
    n = F.lit(n) if isinstance(n, int) else n
    return samples.filter(F.col("idx") >= n).withColumn("idx", (F.col("idx") - n).cast("int"))


def whole_seconds(samples: DataFrame, rate: int, *key: str) -> DataFrame:
    """Without the samples after the last whole second."""
    n = F.count("*").over(Window.partitionBy(*key))
    return samples.withColumn("n", n).filter(F.col("idx") < F.col("n") - F.col("n") % rate).drop("n")


def decimated(samples: DataFrame, by: int, *key: str) -> DataFrame:
    """To a rate that divides the old one: means of `by` neighbours."""
    return samples.groupBy(*key, F.expr(f"cast(idx div {by} as int)").alias("idx")).agg(F.avg("x").alias("x"))


def interpolated(samples: DataFrame, up: int, *key: str) -> DataFrame:
    """To `up` times the rate, linear between neighbours; the last sample holds."""
    after = F.coalesce(F.lead("x").over(Window.partitionBy(*key).orderBy("idx")), F.col("x"))
    steps = samples.withColumn("next", after).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(up - 1))))
    return steps.select(*key, (F.col("idx") * up + F.col("j")).cast("int").alias("idx"), (F.col("x") + (F.col("next") - F.col("x")) * F.col("j") / up).alias("x"))


def pooled(array: Column, k: int) -> Column:
    """Means of each k neighbours of an array, without the rest at its end."""
    whole = F.sequence(F.lit(0), F.floor(F.size(array) / k).cast("int") - 1)
    return F.when(F.size(array) >= k, F.transform(whole, lambda i: F.aggregate(F.slice(array, i * k + 1, k), F.lit(0.0), lambda s, x: s + x) / k)).otherwise(F.array().cast("array<double>"))


def in_region(idx: Column, start: Column | int, length: int, n: int) -> Column:
    """Whether a place is in a region that wraps around the end."""
    return F.pmod(idx - start, F.lit(n)) < length


def flipped(samples: DataFrame, start: int, length: int, n: int) -> DataFrame:
    """The sign of a region's values turned."""
    return samples.withColumn("x", F.when(in_region(F.col("idx"), start, length, n), -F.col("x")).otherwise(F.col("x")))


def mixed(samples: DataFrame, start: int, other: int, length: int, n: int, *key: str) -> DataFrame:
    """A region becomes the mean of itself and another region of the same length."""
    from_other = samples.select(*key, F.pmod(F.col("idx") - (other - start), F.lit(n)).cast("int").alias("idx"), F.col("x").alias("y"))
    both = samples.join(from_other, [*key, "idx"])
    return both.withColumn("x", F.when(in_region(F.col("idx"), start, length, n), (F.col("x") + F.col("y")) / 2).otherwise(F.col("x"))).drop("y")


def filtered(samples: DataFrame, taps: list[float], *key: str) -> DataFrame:
    """A finite impulse response over each key's samples, zero before the first: a sum of lags, so it stays a window."""
    w = Window.partitionBy(*key).orderBy("idx")
    total = sum((F.coalesce(F.lag("x", i).over(w), F.lit(0.0)) * t for i, t in enumerate(taps)), F.lit(0.0))
    return samples.withColumn("x", total)


def band_pass_taps(rate: float, low: float, high: float, taps: int) -> list[float]:
    """A windowed-sinc filter that keeps low to high Hz: the difference of two low-passes under a Hann window."""
    if not 0 <= low < high <= rate / 2 or taps % 2 == 0:
        raise ValueError("0 <= low < high <= rate / 2 and an odd number of taps are needed")
    middle = taps // 2

    def low_pass(cut: float, n: int) -> float:
        x = 2 * cut / rate
        return x if n == 0 else math.sin(math.pi * x * n) / (math.pi * n)

    hann = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (taps + 1)) for i in range(taps)]
    return [(low_pass(high, i - middle) - low_pass(low, i - middle)) * hann[i] for i in range(taps)]


def recursed(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float]) -> np.ndarray:
    """y[n] = b0 x[n] + b1 x[n-1] + b2 x[n-2] - a0 y[n-1] - a1 y[n-2], from rest. The samples are cut into about as many blocks as a block
    has samples: all blocks step together as if from rest, then each gets what the two last values of the block before go on to give."""
    n = len(x)
    length = max(2, math.isqrt(n))
    blocks = -(-n // length)
    padded = np.concatenate(([0.0, 0.0], x, np.zeros(blocks * length - n)))
    y = (b[0] * padded[2:] + b[1] * padded[1:-1] + b[2] * padded[:-2]).reshape(blocks, length)
    # what follows a block that ends in (0, 1) and in (1, 0)
    after = np.zeros((2, length + 2))
    after[0, 1] = after[1, 0] = 1.0
    for t in range(length):
        after[:, t + 2] = -a[0] * after[:, t + 1] - a[1] * after[:, t]
        if t > 0:
            y[:, t] -= a[0] * y[:, t - 1]
        if t > 1:
            y[:, t] -= a[1] * y[:, t - 2]
    for k in range(1, blocks):
        y[k] += y[k - 1, -1] * after[0, 2:] + y[k - 1, -2] * after[1, 2:]
    return y.ravel()[:n]


def biquad(samples: DataFrame, b: tuple[float, float, float], a: tuple[float, float], *key: str) -> DataFrame:
    """A second-order recursive filter, which no window can express: y depends on earlier y. One record at a time is a group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        return frame.assign(x=recursed(frame["x"].to_numpy(float), b, a))

    return samples.groupBy(*key).applyInPandas(run, samples.schema)


def notch(samples: DataFrame, rate: float, freq: float, quality: float, *key: str) -> DataFrame:
    """Takes out one frequency."""
    w = 2 * math.pi * freq / rate
    alpha, c = math.sin(w) / (2 * quality), math.cos(w)
    return biquad(samples, (1 / (1 + alpha), -2 * c / (1 + alpha), 1 / (1 + alpha)), (-2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)), *key)


def sanity(samples: DataFrame, most: float = 5.0) -> DataFrame:
    """mean, std, and whether either is beyond `most`."""
    return samples.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).withColumn("suspect", (F.abs("mean") > most) | (F.col("std") > most))
