"""Anchors: the least of the hashed K-grams in each window of a text.

Equal windows have equal anchors at equal places, wherever they stand. So windows can be dealt out by their anchor's hash, some
sixteen to a record, instead of one by one.
"""

from __future__ import annotations

import numpy as np

#: Length of the strings that are looked for, and of the K-grams whose hashes anchor them.
WINDOW, K = 100, 32
GRAMS = WINDOW - K + 1
#: Bits of a place within a piece (a string of Spark's is under 2**31 bytes); the bits above hold the hash.
PLACE = np.uint64((1 << 32) - 1)
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MIX
    return x ^ x >> np.uint64(29)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    rest = width - step
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


class Piece:
    """The windows of some texts that lie one after another in a byte array, with text i at bounds[i] to bounds[i + 1]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        self.data, self.bounds = data, bounds
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from begin to end, with their number."""
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, first and last start of the windows with one anchor, the anchor's place and its hash."""
        none = np.empty(0, np.int64)
        sizes = np.diff(self.bounds)
        if not (sizes >= WINDOW).any():
            return none, none, none, none, none.view(np.uint64)
        n = len(self.data)
        grams = mixed((self.sums[K:] - self.sums[: n - K + 1]) * self.down[: n - K + 1])
        ranked = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(ranked, GRAMS) & PLACE
        fits = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(sizes >= WINDOW)
        fits[self.bounds[long]] += 1
        fits[self.bounds[long + 1] - WINDOW + 1] -= 1
        start = np.flatnonzero(np.cumsum(fits[: len(least)]) > 0)
        at = least[start]
        turn = np.flatnonzero(at[1:] != at[:-1])
        first, last = start[np.concatenate(([0], turn + 1))], start[np.append(turn, len(start) - 1)]
        text = np.searchsorted(self.bounds, first, side="right") - 1
        anchor = least[first].astype(np.int64)
        return text, first, last, anchor, grams[anchor]
