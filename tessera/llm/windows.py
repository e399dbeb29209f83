"""Sliding minima over hashes, and the anchors they choose."""

from __future__ import annotations

import numpy as np

FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i:i + n] for each i with n values left (doubling: log n passes)."""
    if len(x) < n:
        return x[:0]
    have, out = 1, x
    while 2 * have <= n:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1]) if have < n else out


def smallest(grams: np.ndarray, row_of: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window that lies within its row: the smallest hash of the grams in it.

    grams[i] is the hash of items i to i + gram; row_of[i] is the row of item i. Returns starts and minima: equal windows
    have equal minima, so an anchor (a gram that is a window's minimum) is found wherever the window repeats.
    """
    n = len(row_of) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(grams, window - gram + 1, np.minimum)[:n]
    starts = np.flatnonzero(row_of[:n] == row_of[window - 1 :])
    return starts, least[starts]
