"""Operators by name, and pipelines of them from a configuration: a list of names with settings, applied in order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochal.operators import labels, signals, windows

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    # strip
    "strip_to_match": lambda df, other: labels.matched(df, other),
    "drop_class": lambda df, class_int, column="stage": df.filter(F.col(column) != class_int),
    "trim_psg_trailing": lambda df, last, column="period_idx": df.filter(F.col(column) <= last),
    # quality control
    "clip_noisy_values": lambda df, min_max_times_global_iqr, key: signals.clipped(df, min_max_times_global_iqr, *key),
    "zero_out_noisy_epochs": lambda df, max_times_global_iqr, key, epoch: signals.zeroed(df, max_times_global_iqr, key, epoch),
    # scalers
    "RobustScaler": lambda df, key: signals.scaled(df, "robust", *key),
    "StandardScaler": lambda df, key: signals.scaled(df, "standard", *key),
    "MinMaxScaler": lambda df, key: signals.scaled(df, "minmax", *key),
    "MaxAbsScaler": lambda df, key: signals.scaled(df, "maxabs", *key),
    "QuantileTransformer": lambda df, key: signals.scaled(df, "quantile", *key),
    # rates
    "decimate": lambda df, by, key: signals.decimated(df, by, *key),
    "interpolate": lambda df, up, key: signals.interpolated(df, up, *key),
    "band_pass": lambda df, rate, low, high, taps, key: signals.filtered(df, signals.band_pass_taps(rate, low, high, taps), *key),
    # labels
    "wake_trim": lambda df, around: labels.wake_trimmed(df, around),
    "remove_offset": lambda df: labels.without_offset(df),
    "replace_zero_durations": lambda df, seconds: labels.with_least_duration(df, seconds),
    "fill_gaps": lambda df, label: labels.with_gaps(df, label),
    "to_sparse": lambda df, seconds: labels.run_lengths(df, seconds),
    "to_dense": lambda df, seconds: labels.densified(df, seconds),
    # windows
    "margin_windows": lambda df, m, carry=(): windows.margin_windows(df, m, *carry),
    "chunks": lambda df, length: windows.chunks(df, length),
}


def register(name: str, operator: Callable[..., DataFrame]) -> None:
    """Adds a plug-in; names are taken once."""
    if name in OPERATORS:
        raise ValueError(f"{name} is taken")
    OPERATORS[name] = operator


def applied(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    """Each step is {"name": ..., settings}. All names are checked before anything is built; the result is one plan."""
    unknown = [s.get("name") for s in steps if s.get("name") not in OPERATORS]
    if unknown:
        raise ValueError(f"no operators named {unknown}; there are {sorted(OPERATORS)}")
    for step in steps:
        settings = {k: v for k, v in step.items() if k != "name"}
        df = OPERATORS[step["name"]](df, **settings)
    return df
