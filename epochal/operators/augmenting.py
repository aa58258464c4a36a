"""Augmenters by name, with the settings of a configuration, one after another over elements of several channels.

An element is a row: a key, channels (array columns of one length), a weight, and perhaps labels, one a sample. An augmenter applies to an
element with its probability, draws its parameters for that element, and multiplies the weight where it applies. The draws of the n-th
augmenter are hashes of the key and of seed + n, so they depend on neither partitions nor the other augmenters. Everything is expressions
on one row: a list of augmenters is one pass without a shuffle.

Null and empty channels stay as they are, and null samples stay null unless a region or a channel is replaced; labels of another length than
the channels don't move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.operators import augment
from epochal.operators.augment import bound
from epochal.operators.sampling import normal, uniform

Setting = float | list[float] | tuple[float, float]
PLACES = "_places"


@dataclass(frozen=True)
class Elements:
    """What is augmented: the names of the key, the channels and the labels."""

    key: str
    channels: list[str]
    labels: str | None = None

    def each(self, change: Callable[[str], Column]) -> dict[str, Column]:
        return {c: change(c) for c in self.channels}

    def mean(self) -> Column:
        """Of all samples of all channels."""
        every = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<double>")) for c in self.channels)))
        return augment.mean(every)

    def region(self, seed: int, low: float, high: float, log_sample: bool) -> tuple[Column, Column]:
        return augment.drawn_region(F.col(self.channels[0]), self.key, low, high, seed, log_sample)


def parameter(setting: Setting, key: str, name: str, seed: int) -> Column:
    """A number, or for two of them one drawn between them for each element."""
    if not isinstance(setting, (list, tuple)):
        return F.lit(float(setting))
    low, high = bounds(setting, name)
    return low + (high - low) * uniform(seed, F.col(key), F.lit(name))


def bounds(setting: Setting, name: str) -> tuple[float, float]:
    if not isinstance(setting, (list, tuple)):
        return float(setting), float(setting)
    if len(setting) != 2 or setting[1] <= setting[0]:
        raise ValueError(f"{name}: a number or two ascending numbers, not {setting}")
    return float(setting[0]), float(setting[1])


def fractions(low: float, high: float) -> None:
    if not 0 < low <= high <= 1:
        raise ValueError(f"shares of an element are above 0 and at most 1, in order, not {low} and {high}")


def smoothed(moves: Column, kernel: Column, i: Column, reach: int) -> Column:
    """The kernel's mean of the 2 reach + 1 moves around place i; moves begin reach places before the element."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * reach)), F.lit(0.0), lambda s, k: s + F.get(kernel, k) * F.get(moves, i + k))


def places(n: Column, key: str, alpha: Setting, sigma: Setting, seed: int) -> Column:
    """Where each of n places takes its sample from: random moves, none outside the element, smoothed by a Gaussian out to three sigma and
    alpha times as far."""
    reach = max(1, int(3 * bounds(sigma, "sigma")[1]))
    bounds(alpha, "alpha")

    def kernel(s: Column) -> Column:
        near = lambda k: F.abs(k) <= F.greatest(F.lit(1.0), F.floor(3 * s))
        weights = F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.when(near(k), F.exp(-0.5 * F.pow(k / s, F.lit(2.0)))).otherwise(0.0))
        return bound(weights, lambda w: bound(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(w, lambda x: x / total)))

    def move(i: Column) -> Column:
        return F.when((i >= 0) & (i < n), 2 * uniform(seed, F.col(key), i) - 1).otherwise(0.0)

    moves = F.transform(F.sequence(F.lit(-reach), n + (reach - 1)), move)
    drawn = F.struct(parameter(alpha, key, "alpha", seed).alias("alpha"), kernel(parameter(sigma, key, "sigma", seed)).alias("kernel"), moves.alias("moves"))
    made = bound(drawn, lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda i: i + d["alpha"] * smoothed(d["moves"], d["kernel"], i, reach)))
    return F.when(n > 0, made)


def elastic(df: DataFrame, e: Elements, seed: int, alpha: Setting, sigma: Setting, fill: float = 0.0) -> tuple[DataFrame, dict[str, Column]]:
    """All channels are taken from the same moved places, linearly between two samples; labels from the nearest place, of two the lower.
    Places outside the element give fill, and label 0."""
    n = F.size(e.channels[0])
    df = df.withColumn(PLACES, places(n, e.key, alpha, sigma, seed))
    inside = lambda p: (p >= 0) & (p <= n - 1)

    def channel(name: str) -> Column:
        x = F.col(name)

        def at(p: Column) -> Column:
            low = F.floor(p).cast("int")
            return F.get(x, low) + (p - low) * (F.get(x, F.least(low + 1, n - 1)) - F.get(x, low))

        return F.when(n > 0, F.transform(PLACES, lambda p: F.when(inside(p), at(p)).otherwise(fill))).otherwise(x)

    made = e.each(channel)
    if e.labels and df.schema[e.labels].dataType.typeName() == "array":
        y, kind = F.col(e.labels), df.schema[e.labels].dataType.elementType
        moved = F.transform(PLACES, lambda p: F.when(inside(p), F.get(y, F.ceil(p - 0.5).cast("int"))).otherwise(F.lit(0).cast(kind)))
        made[e.labels] = F.when((n > 0) & (F.size(y) == n), moved).otherwise(y)
    return df, made


def amplitude(df, e, seed, min_scaling, max_scaling):
    return df, e.each(lambda c: bound(augment.between(min_scaling, max_scaling, e.key, seed), lambda f: augment.amplitude(F.col(c), f)))


def shift(df, e, seed, min_shift, max_shift):
    return df, e.each(lambda c: bound(augment.between(min_shift, max_shift, e.key, seed), lambda by: augment.shift(F.col(c), by)))


def noise(df, e, seed, sigma, mean=0.0):
    return df, e.each(lambda c: F.transform(c, lambda v, i: v + mean + sigma * normal(seed, F.col(e.key), F.lit(c), i)))


def channel_dropout(df, e, seed, drop_fraction):
    return df, dict(augment.channel_dropout(e.channels, e.key, drop_fraction, seed))


def regional_noise(df, e, seed, min_region_fraction, max_region_fraction, mean=0.0, sigma=0.1, log_sample=True):
    fractions(min_region_fraction, max_region_fraction)
    start, length = e.region(seed, min_region_fraction, max_region_fraction, log_sample)
    return df, e.each(lambda c: augment.region(F.col(c), start, length, lambda v, i: v + mean + sigma * normal(seed, F.col(e.key), F.lit(c), i)))


def regional_erase(df, e, seed, min_region_fraction, max_region_fraction, log_sample=True):
    """To faint noise about the mean of all channels."""
    fractions(min_region_fraction, max_region_fraction)
    start, length = e.region(seed, min_region_fraction, max_region_fraction, log_sample)
    faint = lambda c, i: augment.FAINT * normal(seed, F.col(e.key), F.lit(c), i)
    return df, e.each(lambda c: bound(e.mean(), lambda m: augment.region(F.col(c), start, length, lambda v, i: m + faint(c, i))))


def regional_mix(df, e, seed, min_region_fraction, max_region_fraction, log_sample=True):
    fractions(min_region_fraction, max_region_fraction)
    start, length = e.region(seed, min_region_fraction, max_region_fraction, log_sample)
    other = augment.drawn_start(F.col(e.channels[0]), e.key, "other", seed)
    return df, e.each(lambda c: augment.signal_mix(F.col(c), start, other, length))


def regional_flip(df, e, seed, min_region_fraction, max_region_fraction, log_sample=True):
    fractions(min_region_fraction, max_region_fraction)
    start, length = e.region(seed, min_region_fraction, max_region_fraction, log_sample)
    return df, e.each(lambda c: augment.sign_flip(F.col(c), start, length))


#: The names that configurations use.
AUGMENTERS: dict[str, Callable[..., tuple[DataFrame, dict[str, Column]]]] = {
    "GlobalElasticDeformations": elastic,
    "GlobalAmplitude": amplitude,
    "GlobalShift": shift,
    "GlobalGaussianNoise": noise,
    "ChannelDropout": channel_dropout,
    "RegionalGaussianNoise": regional_noise,
    "RegionalErase": regional_erase,
    "RegionalSignalMix": regional_mix,
    "RegionalSignFlip": regional_flip,
}


def augmented(df: DataFrame, elements: Elements, steps: list[dict[str, Any]] | None, seed: int = 0) -> DataFrame:
    """df with its elements augmented, and a weight (1 where there was none). A step is {"cls_name": ..., "kwargs": {...}}; kwargs hold
    apply_prob, perhaps aug_weight (one half by default), and the augmenter's own. All names are checked before anything is built."""
    steps = [] if steps is None else steps
    if not isinstance(steps, (list, tuple)) or not all(isinstance(s, dict) for s in steps):
        raise TypeError("augmenters are a list of dictionaries")
    unknown = [s.get("cls_name") for s in steps if s.get("cls_name") not in AUGMENTERS]
    if unknown:
        raise ValueError(f"no augmenters named {unknown}; there are {sorted(AUGMENTERS)}")
    out = df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))
    for place, step in enumerate(steps):
        settings = dict(step.get("kwargs", {}))
        p, weight = settings.pop("apply_prob"), settings.pop("aug_weight", 0.5)
        if not 0 <= p <= 1:
            raise ValueError(f"apply_prob is a probability, not {p}")
        hit = uniform(seed + place, F.col(elements.key)) < p
        out, made = AUGMENTERS[step["cls_name"]](out, elements, seed + place, **settings)
        made["weight"] = F.col("weight") * weight
        out = out.withColumns({c: F.when(hit, new).otherwise(F.col(c)) for c, new in made.items()}).drop(PLACES)
    return out
