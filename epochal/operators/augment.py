"""Augmenters over array columns, as expressions. The transforms take their parameters; `between` and `drawn_region` draw them by seeded
hash, and `drawn` decides per element whether it changes. Draws depend on keys and seeds only, never on partitions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.functions.scalars import bound
from epochal.operators.sampling import normal, uniform

#: Fixed value: the spread of the noise that stands for what is erased or dropped.
FAINT = 0.01


def drawn(df: DataFrame, key: str, column: str, transform: Callable[[Column], Column], p: float, seed: int, weight: float = 1.0) -> DataFrame:
    """Applies a transform to a share p of the elements; weight, if there is such a column, is multiplied where it applies."""
    hit = uniform(seed, F.col(key)) < p
    out = df.withColumn(column, F.when(hit, transform(F.col(column))).otherwise(F.col(column)))
    return out.withColumn("weight", F.when(hit, F.col("weight") * weight).otherwise(F.col("weight"))) if "weight" in df.columns else out


def amplitude(x: Column, factor: Column | float) -> Column:
    return F.transform(x, lambda v: v * factor)


def shift(x: Column, by: Column | float) -> Column:
    return F.transform(x, lambda v: v + by)


def between(low: float, high: float, key: str, seed: int) -> Column:
    """A uniform parameter for each element."""
    return low + (high - low) * uniform(seed, F.col(key), F.lit("parameter"))


def log_uniform(u: Column, low: float, high: float) -> Column:
    return F.pow(F.lit(10.0), F.log10(F.lit(low)) + u * (F.log10(F.lit(high)) - F.log10(F.lit(low))))


def in_region(i: Column, start: Column, length: Column, n: Column) -> Column:
    return F.pmod(i - start, n) < length


def region(x: Column, start: Column, length: Column, change: Callable[[Column, Column], Column]) -> Column:
    """Changes a circular region of an array; change gets the value and its place."""
    inside = lambda r: F.transform(x, lambda v, i: F.when(in_region(i, r["start"], r["length"], r["n"]), change(v, i)).otherwise(v))
    return bound(F.struct(start.alias("start"), length.alias("length"), F.size(x).alias("n")), inside)


def drawn_region(x: Column, key: str, low: float, high: float, seed: int, log_sample: bool = True) -> tuple[Column, Column]:
    """start, length: a uniform start, and a share of the element that is log-uniform between low and high; without log_sample, a length
    that is uniform between those of the two shares."""
    n, u = F.size(x), uniform(seed, F.col(key), F.lit("length"))
    least, most = (F.floor(f * n) for f in (low, high))
    length = F.floor(log_uniform(u, low, high) * n) if log_sample else F.floor(least + u * (most - least))
    return drawn_start(x, key, "start", seed), length.cast("int")


def drawn_start(x: Column, key: str, name: str, seed: int) -> Column:
    return F.floor(uniform(seed, F.col(key), F.lit(name)) * F.size(x)).cast("int")


def mean(x: Column) -> Column:
    """Of the samples that aren't null; null if there are none."""
    return bound(F.filter(x, F.isnotnull), lambda y: F.try_divide(F.aggregate(y, F.lit(0.0), lambda s, v: s + v), F.size(y)))


def erase(x: Column, start: Column, length: Column, key: str | None = None, seed: int = 0) -> Column:
    """A region set to the mean of the whole, with faint noise if a key is given."""
    noise = (lambda i: FAINT * normal(seed, F.col(key), i)) if key else (lambda i: F.lit(0.0))
    return bound(mean(x), lambda m: region(x, start, length, lambda v, i: m + noise(i)))


def sign_flip(x: Column, start: Column, length: Column) -> Column:
    return region(x, start, length, lambda v, i: -v)


def signal_mix(x: Column, start: Column, other: Column, length: Column) -> Column:
    """A region as the mean of itself and the region from `other`, which wraps around."""
    return bound(other - start, lambda by: region(x, start, length, lambda v, i: (v + F.get(x, F.pmod(i + by, F.size(x)))) / 2))


def channel_dropout(channels: list[str], key: str, fraction: float, seed: int) -> list[tuple[str, Column]]:
    """name and new column for each channel: at least one goes to faint noise about its mean, never all."""
    drop = max(int(len(channels) * fraction), 1)
    if drop >= len(channels):
        raise ValueError("all channels would be dropped")
    ranks = F.array_sort(F.array(*(F.struct(uniform(seed, F.col(key), F.lit(c)).alias("u"), F.lit(c).alias("c")) for c in channels)))
    gone = F.transform(F.slice(ranks, 1, drop), lambda s: s["c"])
    faint = lambda c: bound(mean(F.col(c)), lambda m: F.transform(c, lambda v, i: m + FAINT * normal(seed, F.col(key), F.lit(c), i)))
    return [(c, F.when(F.array_contains(gone, F.lit(c)), faint(c)).otherwise(F.col(c))) for c in channels]


def noisy(df: DataFrame, key: str, column: str, sigma: float, seed: int) -> DataFrame:
    """Gaussian noise on arrays."""
    return df.withColumn(column, F.transform(column, lambda v, i: v + sigma * normal(seed, F.col(key), i)))


def noisy_region(df: DataFrame, key: str, column: str, sigma: float, low: float, high: float, seed: int) -> DataFrame:
    """Gaussian noise on a circular region whose share of the element is log-uniform between low and high."""
    start, length = drawn_region(F.col(column), key, low, high, seed)
    return df.withColumn(column, region(F.col(column), start, length, lambda v, i: v + sigma * normal(seed, F.col(key), i)))


def smoothing(sigma: float) -> list[float]:
    """Weights of a Gaussian kernel out to three sigma."""
    radius = max(1, int(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def elastic(df: DataFrame, key: str, column: str, alpha: float, sigma: float, seed: int) -> DataFrame:
    """Smoothed random displacement of places with linear interpolation."""
    kernel, x = smoothing(sigma), F.col(column)
    n = F.size(x)
    moves = F.transform(F.sequence(F.lit(0), n + len(kernel) - 2), lambda i: 2 * uniform(seed, F.col(key), i) - 1)
    weighed = lambda m, i: sum((w * F.get(m, i + k) for k, w in enumerate(kernel)), F.lit(0.0))
    place = lambda m, i: F.greatest(F.lit(0.0), F.least(n - 1.0, i + alpha * weighed(m, i)))
    low = lambda p: F.floor(p).cast("int")
    between_two = lambda p: F.get(x, low(p)) + (p - low(p)) * (F.get(x, F.least(n - 1, low(p) + 1)) - F.get(x, low(p)))
    places = bound(moves, lambda m: F.transform(x, lambda v, i: place(m, i)))
    return df.withColumn(column, F.when(n > 0, F.transform(places, between_two)).otherwise(x))
