"""Suffix arrays by linear grouping, of many short strings at once.

Phase 1 keeps the suffixes of a string in groups, at first by their first symbol, and processes the groups in descending order.
A suffix's previous-smaller pointer goes to the nearest suffix before it in a lower group. The suffixes that the pointers of the
processed group hit move, within their own groups, behind the others, those hit more often further; so a group comes to
hold the suffixes with one Lyndon prefix, and groups stand in the order of these prefixes. Phase 2 goes through the suffixes in
order as they become known and, for each, puts the suffixes whose prefix ends where it begins, which the pointers lead to, at
the front of what is left of their groups. No names are given anew and nothing recurses.

Strings are independent, so each step handles the current group of every string: numpy runs over the strings, not along them.
"""

from __future__ import annotations

import numpy as np


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... size[0] of them, then those of begin[1] and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def suffix_arrays(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """symbols: the strings one after another, string i from begin[i]; each ends with a symbol lower than all its others. The
    places of each string's suffixes in order, in the string's own stretch of the result."""
    n = len(symbols)
    ends = np.append(begin[1:], n)
    owner = np.repeat(np.arange(len(begin)), ends - begin)
    front = begin[owner]  # by place: where its string begins
    at = np.argsort(owner * (int(symbols.max(initial=0)) + 1) + symbols, kind="stable")  # by slot: the suffix there
    slot = np.empty(n, np.int64)
    slot[at] = np.arange(n)
    key = owner[at] * (int(symbols.max(initial=0)) + 1) + symbols[at]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.zeros(n, np.int64)  # by first slot of a group
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)  # by suffix: its group's first slot
    group[at] = np.repeat(first, size[first])
    before = np.full(n, -1, np.int64)  # the previous-smaller pointers
    moving = np.zeros(n, bool)

    current, low = group[at[ends - 1]], begin  # each string's highest group
    while len(current):
        members = at[ragged(current, size[current])]
        here = np.repeat(current, size[current])
        prior = members - 1
        prior[prior < front[members]] = -1
        chase = np.flatnonzero(prior >= 0)
        while len(chase):
            chase = chase[group[prior[chase]] > here[chase]]
            prior[chase] = before[prior[chase]]
            chase = chase[prior[chase] >= 0]
        before[members] = prior
        chase = np.flatnonzero(prior >= 0)
        while len(chase):  # those that point into the group point on from there
            chase = chase[group[prior[chase]] == here[chase]]
            prior[chase] = before[prior[chase]]
            before[members[chase]] = prior[chase]
            chase = chase[prior[chase] >= 0]
        hit, times = np.unique(prior[prior >= 0], return_counts=True)
        if len(hit):
            own = group[hit]
            order = np.lexsort((times, own))
            hit, times, own = hit[order], times[order], own[order]
            head = np.concatenate(([True], own[1:] != own[:-1]))
            start = np.flatnonzero(head)
            count = np.diff(np.append(start, len(own)))
            tail = np.repeat(own[start] + size[own[start]] - count, count)  # first slot of what moves
            to = tail + np.arange(len(own)) - np.repeat(start, count)
            moving[hit] = True
            there = at[to]
            there = there[~moving[there]]
            held = slot[hit]
            holes = held[held < tail]
            at[holes], slot[there] = there, holes
            at[to], slot[hit] = hit, to
            moving[hit] = False
            size[own[start]] -= count
            head[1:] |= times[1:] != times[:-1]
            part = np.flatnonzero(head)
            width = np.diff(np.append(part, len(own)))
            group[hit] = np.repeat(to[part], width)
            size[to[part]] = width
        left = current > low
        current, low = current[left], low[left]
        current = group[at[current - 1]]

    out = np.full(n, -1, np.int64)
    free, placed = np.arange(n), np.zeros(n, bool)
    out[begin] = ends - 1
    placed[ends - 1] = True
    step, live, live_ends = 0, begin, ends
    while len(live):
        prior = out[live + step] - 1
        prior = prior[prior >= front[out[live + step]]]
        while len(prior):
            prior = prior[~placed[prior]]
            put = free[group[prior]]
            out[put] = prior
            free[group[prior]] += 1
            placed[prior] = True
            prior = before[prior]
            prior = prior[prior >= 0]
        step += 1
        keep = live_ends - live > step
        live, live_ends = live[keep], live_ends[keep]
    return out
