"""Channels: names, types, references and fallbacks, as expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channel types, and the name prefixes that tell them.
TYPES = ("EEG", "EOG", "EMG", "ECG")
PREFIXES = {"EEG": "C|F|O|P|T|EEG", "EOG": "E1|E2|EOG|ROC|LOC", "EMG": "CHIN|EMG", "ECG": "ECG|EKG"}
#: Scalp electrodes and the mastoid on the other side.
MASTOIDS = {"C3": "A2", "C4": "A1", "F3": "A2", "F4": "A1", "O1": "A2", "O2": "A1"}
#: Other names of the mastoids.
ALSO = {"A1": "M1", "A2": "M2"}


def name_of(spec: Column) -> Column:
    """Of NAME==TYPE or NAME."""
    return F.trim(F.split(spec, "==")[0])


def type_of(spec: Column) -> Column:
    """The given type in upper case, else that which the name's prefix tells, else null."""
    given = F.upper(F.trim(F.get(F.split(spec, "=="), F.lit(1))))
    inferred = F.coalesce(*(F.when(F.upper(name_of(spec)).rlike(f"^({PREFIXES[t]})"), F.lit(t)) for t in ("EOG", "ECG", "EMG", "EEG")))
    return F.when(given.isin(*TYPES), given).when(given.isNotNull(), F.raise_error(F.concat(F.lit("no channel type "), given)).cast("string")).otherwise(inferred)


def reference_of(name: Column) -> Column:
    """The mastoid that a scalp channel is referenced to, else null."""
    return F.element_at(F.create_map(*(F.lit(x) for p in MASTOIDS.items() for x in p)), F.upper(name))


def available(wanted: Column, there: Column) -> Column:
    """The wanted channels that are there, in the wanted order."""
    return F.filter(wanted, lambda c: F.array_contains(there, c))


def first_available(candidates: Column, there: Column) -> Column:
    return F.get(available(candidates, there), F.lit(0))


def selected(signals: Column, names: list[str]) -> Column:
    """Entries of a map from channel to signal, by name."""
    return F.map_filter(signals, lambda k, _: k.isin(*names))


def distinct_channels(groups: Column) -> Column:
    return F.array_distinct(F.flatten(groups))


def referenced(there: Column) -> Column:
    """Of a study's channel names, what to load: scalp channels as NAME-MASTOID where the study has the opposite mastoid under one of its
    names and itself isn't one, others as they are, mastoids not by themselves. The order stays; nulls go; no channels give none."""
    mastoids = [m for pair in ALSO.items() for m in pair]

    def one(name: Column) -> Column:
        first = reference_of(name)
        second = F.element_at(F.create_map(*(F.lit(x) for p in ALSO.items() for x in p)), first)
        found = F.get(F.filter(there, lambda c: F.upper(c).isin(*mastoids) & ((F.upper(c) == first) | (F.upper(c) == second))), F.lit(0))
        return F.coalesce(F.concat(name, F.lit("-"), found), name)

    return F.transform(F.filter(there, lambda c: c.isNotNull() & ~F.upper(c).isin(*mastoids)), one)


def combinations(groups: Column) -> Column:
    """Of an array of channel groups, one channel of each in every way, in the order of the groups. Of those with one set of channels the
    first stays. A group without channels leaves nothing, no groups the one empty choice."""
    empty = F.array(F.array().cast("array<string>"))
    product = F.aggregate(groups, empty, lambda done, group: F.flatten(F.transform(done, lambda d: F.transform(group, lambda c: F.concat(d, F.array(c))))))
    keys = F.transform(product, lambda c: F.to_json(F.array_sort(F.array_distinct(c))))
    return F.filter(product, lambda c, i: F.array_position(keys, F.get(keys, i)) == i + 1)
