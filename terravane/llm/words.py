"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

from terravane.llm.common import LOWER

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
MIX = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


_UP = _DOWN = np.ones(1, np.uint64)


class Words:
    """The words of texts that lie one after another: hash, length and row of each, and their letters without gaps.

    kind: which bytes, after lower-casing A-Z, belong to words.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray):
        global _UP, _DOWN
        low = LOWER[data]
        inside = kind[low]
        n = len(low)
        if len(_UP) <= n:
            _UP, _DOWN = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]
        begin[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        self.begin, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum(low.astype(np.uint64) * _UP[:n])]
            h = (total[self.end] - total[self.begin]) * _DOWN[self.begin]
            self.hash = (h ^ (h >> np.uint64(29))) * MIX[0]
        self.length = self.end - self.begin
        self.first = np.searchsorted(self.begin, bounds)  # first word of each row
        self.letters = low[inside]
        self.place = np.r_[0, np.cumsum(self.length)]

    def shingles(self, k: int) -> np.ndarray:
        return shingles(self.hash, k)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes."""
    n = max(len(words) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j : j + n] * MIX[j]
        return out ^ (out >> np.uint64(32))
