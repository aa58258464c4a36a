"""Scalar functions as column expressions: names, durations, arrays and convolution arithmetic. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row; inside a lambda of arrays it would be computed once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_name(path: Column) -> Column:
    """The last part of a path, without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def number_in(name: Column, pattern: str) -> Column:
    """The one decimal number that a pattern captures, else null."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).try_cast("double")


def suffix_number(name: Column, separator: str = "_") -> Column:
    """The number after the last separator, for sorting split_10 after split_9."""
    return F.element_at(F.split(name, separator), -1).try_cast("int")


def joined(parts: Column, separator: str = "+") -> Column:
    return F.array_join(parts, separator)


def seconds_in(text: Column) -> Column:
    """Seconds of durations like 01d 02h 03m 04s, of which any part may be missing."""
    part = lambda unit, worth: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+)\s*{unit}", 1), F.lit("")).try_cast("bigint"), F.lit(0)) * worth
    return part("d", 86400) + part("h", 3600) + part("m", 60) + part("s", 1)


def period_of(seconds: Column, length: int) -> Column:
    return F.floor(seconds / length).cast("int")


def is_whole(x: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(x - F.round(x)) <= tolerance


def gib(size: Column) -> Column:
    return size / float(1 << 30)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, F.lit(1.0)).otherwise(F.lit(0.0)))


def evenly_smoothed(target: Column, alpha: Column | float) -> Column:
    """(1 - alpha) y + alpha / n."""
    return F.transform(target, lambda y: y * (1 - F.lit(alpha) if isinstance(alpha, float) else 1 - alpha) + (F.lit(alpha) if isinstance(alpha, float) else alpha) / F.size(target))


def taken_around(array: Column, start: Column, length: Column) -> Column:
    """A stretch of an array that goes on at its beginning after its end."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(array, F.pmod(start + i, F.size(array))))


def softmax(scores: Column) -> Column:
    exps = lambda y: bound(F.array_max(y), lambda most: F.transform(y, lambda s: F.exp(s - most)))
    shares = lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total))
    return bound(scores, lambda y: bound(exps(y), shares))


def conv_size(n: Column, kernel: int, stride: int = 1, padding: int = 0, dilation: int = 1) -> Column:
    """Samples that a convolution leaves."""
    return F.floor((n + 2 * padding - dilation * (kernel - 1) - 1) / stride).cast("int") + 1
