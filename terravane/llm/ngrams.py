"""Numpy views of normalised letters: lower case, everything that is no letter of ASCII or beyond it a single space."""

from __future__ import annotations

import numpy as np

#: ASCII letters in lower case and all bytes beyond ASCII stay; what else there is becomes a space.
FOLDED = np.full(256, 0x20, np.uint8)
FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLDED[0x80:] = np.arange(0x80, 0x100)


def letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of texts that lie one after another, each led and ended by one space, and their new bounds."""
    n = len(bounds) - 1
    at = np.repeat(bounds, np.r_[np.ones(1, np.int64), np.full(max(n - 1, 0), 2), np.ones(1, np.int64)]) if n else np.zeros(0, np.int64)
    out = np.insert(FOLDED[data], at, 0x20) if n else data[:0]
    new = bounds + 2 * np.arange(n + 1)
    capital = np.zeros(len(out), bool)  # capitals of Latin-1 in UTF-8
    capital[1:] = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[capital] += 0x20
    space = out == 0x20
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[new[:-1]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][new]


def codes(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams inside each text as integers of their bytes and their order, and the texts' new bounds."""
    n = max(len(data) - order + 1, 0)
    code = np.full(n, order, np.uint64)
    for k in range(order):
        code = (code << np.uint64(8)) | data[k : k + n]
    inside = np.ones(n, bool)
    for k in range(1, order):
        over = bounds[1:] - k
        inside[over[(over >= 0) & (over < n)]] = False
    return code[inside], np.r_[0, np.cumsum(inside)][np.minimum(bounds, n)]
