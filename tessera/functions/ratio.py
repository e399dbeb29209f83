"""How alike two texts are: twice the length of their common blocks, over both lengths (Ratcliff and Obershelp).

The longest common block is taken (of several the first in the left text, then in the right), then the longest ones before
and behind it, and so on. One table of run lengths (how many characters before each pair of places agree) serves all of
these: a part of the two texts only cuts its runs short. In a right text of 200 characters or more, characters that make
up over a hundredth of it begin no block, they only lengthen one.

A ratio is at most twice the shorter length, or twice the common characters in any order, over both lengths: joins by likeness
compare the rest only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cells of a table of run lengths; two longer texts are compared row by row.
CELLS = 1 << 22

# From which length of the right text frequent characters begin no block, and what share makes one frequent.
FREQUENT_FROM, FREQUENT_SHARE = 200, 100


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Runs:
    """Lengths of runs of equal characters of a and b that end at each pair of places."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b, self.open = a, b, np.ones(len(b), bool)
        if len(b) >= FREQUENT_FROM:
            values, place, n = np.unique(b, return_inverse=True, return_counts=True)
            self.open = (n <= len(b) // FREQUENT_SHARE + 1)[place]
        self.whole = np.stack(list(self.rows(0, len(a), 0, len(b)))) if 0 < len(a) * len(b) <= CELLS else None

    def rows(self, a_low: int, a_high: int, b_low: int, b_high: int) -> Iterator[np.ndarray]:
        b, allowed = self.b[b_low:b_high], self.open[b_low:b_high]
        last = np.zeros(b_high - b_low, np.int32)
        for x in self.a[a_low:a_high]:
            run = np.zeros_like(last)
            run[1:] = last[:-1]
            last = np.where((b == x) & allowed, run + 1, 0).astype(np.int32)
            yield last

    def longest(self, a_low: int, a_high: int, b_low: int, b_high: int) -> tuple[int, int, int]:
        """Where the longest block within both ranges begins, and its length."""
        best, end = 0, (a_low, b_low)
        if self.whole is not None:
            inner = self.whole[a_low:a_high, b_low:b_high]
            cut = np.minimum(inner, np.minimum(np.arange(1, a_high - a_low + 1)[:, None], np.arange(1, b_high - b_low + 1)))
            at = int(cut.argmax())
            best = int(cut.flat[at])
            end = (a_low + at // cut.shape[1] + 1, b_low + at % cut.shape[1] + 1)
        else:
            for i, row in enumerate(self.rows(a_low, a_high, b_low, b_high), a_low + 1):
                if row.max() > best:
                    best, end = int(row.max()), (i, b_low + int(row.argmax()) + 1)
        i, j = (end[0] - best, end[1] - best) if best else (a_low, b_low)
        if not self.open.all():
            while i > a_low and j > b_low and self.a[i - 1] == self.b[j - 1]:
                i, j, best = i - 1, j - 1, best + 1
            while i + best < a_high and j + best < b_high and self.a[i + best] == self.b[j + best]:
                best += 1
        return i, j, best


def common(left: str, right: str) -> int:
    """Characters in common blocks."""
    if left == right:
        return len(left)
    runs, total = _Runs(_codes(left), _codes(right)), 0
    parts = [(0, len(left), 0, len(right))]
    while parts:
        a_low, a_high, b_low, b_high = parts.pop()
        if a_low == a_high or b_low == b_high:
            continue
        i, j, n = runs.longest(a_low, a_high, b_low, b_high)
        if n:
            total += n
            parts += [(a_low, i, b_low, j), (i + n, a_high, j + n, b_high)]
    return total


@lru_cache(1 << 16)
def ratio(left: str, right: str) -> float:
    both = len(left) + len(right)
    return 2.0 * common(left, right) / both if both else 1.0


@lru_cache(1 << 14)
def _bag(text: str) -> Counter:
    return Counter(text)


def most(left: str, right: str) -> float:
    """What the ratio can't pass: the common characters in any order."""
    both = len(left) + len(right)
    return 2.0 * (_bag(left) & _bag(right)).total() / both if both else 1.0


def bounded_ratio(left: str, right: str, least: float) -> float:
    """The ratio, or 0 where a bound shows that it is below `least`."""
    both = len(left) + len(right)
    if both and (2.0 * min(len(left), len(right)) / both < least or most(left, right) < least):
        return 0.0
    return ratio(left, right)


def ratio_of(left: Column, right: Column, least: float = 0.0) -> Column:
    """The ratio of two columns (null if either is null); where it is below `least`, 0 may stand instead."""

    @F.pandas_udf(DoubleType())
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else bounded_ratio(x, y, least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return compared(left, right)


def best_ratio_of(left: Column, others: Column) -> Column:
    """The best ratio of a text with any of several (0 without any; empty texts count for nothing)."""

    @F.pandas_udf(DoubleType())
    def compared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max((ratio(x, y) for y in ys if y), default=0.0) if x and ys is not None else 0.0 for x, ys in zip(a, b, strict=True)], dtype="float64")

    return compared(left, others)


def long_enough(left: Column, right: Column, least: float) -> Column:
    """Whether the lengths alone allow a ratio of `least`: a join's condition, computed in the JVM."""
    n, m = F.length(left), F.length(right)
    return 2.0 * F.least(n, m) >= F.lit(least) * (n + m)


def alike(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: float) -> DataFrame:
    """Rows of both sides that agree in `keys` and whose texts a and b have a ratio of `least` or more, with the `ratio`.
    Each distinct pair of texts is compared once."""
    pairs = left.join(right, keys).where(long_enough(F.col(a), F.col(b), least))
    texts = pairs.select(a, b).distinct().withColumn("ratio", ratio_of(F.col(a), F.col(b), least)).where(F.col("ratio") >= least)
    return pairs.join(texts, [a, b])
