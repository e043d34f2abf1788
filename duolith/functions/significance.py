"""Tails of distributions for p-values.

The terms of a distribution are taken in proportion to the largest one, from
which they fall off on both sides; each is a ratio times its neighbour, and
what lies beyond a few tens of standard deviations vanishes. So a tail takes as
many steps as the standard deviation has units, some ten thousand for a billion
rows, and these are cumulative products of arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_STEP = 1 << 12


def _fall(start: int, stop: int, step: int, ratio: Callable[[np.ndarray], np.ndarray], k: int) -> tuple[float, float]:
    """The sum of the terms from start towards stop, as parts of the term before start, and of those at k or above."""
    total = above = 0.0
    last, size = 1.0, _STEP
    while (stop - start) * step >= 0 and last > 0:
        at = np.arange(start, stop + step if (stop - start) * step < size else start + step * size, step, dtype=np.float64)
        terms = last * np.cumprod(ratio(at))
        total += terms.sum()
        above += terms[at >= k].sum()
        last, start, size = float(terms[-1]), int(at[-1]) + step, min(2 * size, 1 << 16)
        if last < 1e-18 and (step < 0 or start > k) and last < 1e-17 * max(above, 1e-300):
            break
        if step < 0 and last < 1e-18:
            break
    return total, above


def _tail(k: int, low: int, high: int, mode: int, up: Callable[[np.ndarray], np.ndarray], down: Callable[[np.ndarray], np.ndarray]) -> float:
    """The probability of k or more, between low and high. up and down: the term at i as part of its neighbour towards the mode."""
    if k <= low:
        return 1.0
    if k > high:
        return 0.0
    more, more_above = _fall(mode + 1, high, 1, up, k)
    less, less_above = _fall(mode - 1, low, -1, down, k)
    here = 1.0 if mode >= k else 0.0
    return float(min(1.0, (here + more_above + less_above) / (1.0 + more + less)))


def hypergeometric_tail(k: int, n: int, left: int, right: int) -> float:
    """The probability that random sets of these sizes among n rows have k rows in common or more."""
    low, high = max(0, left + right - n), min(left, right)
    mode = min(max((left + 1) * (right + 1) // (n + 2), low), high)
    spare = n - left - right
    up = lambda i: (left - i + 1) * (right - i + 1) / (i * (spare + i))
    down = lambda i: (i + 1) * (spare + i + 1) / ((left - i) * (right - i))
    return 1.0 if k <= 0 else _tail(k, low, high, mode, up, down)


def binomial_tail(k: int, n: int, p: float) -> float:
    """The probability of k successes or more in n trials."""
    if k <= 0:
        return 1.0
    if p <= 0 or k > n:
        return 0.0
    if p >= 1:
        return 1.0
    odds = p / (1 - p)
    mode = min(int((n + 1) * p), n)
    return _tail(k, 0, n, mode, lambda i: (n - i + 1) / i * odds, lambda i: (i + 1) / ((n - i) * odds))


@F.pandas_udf(DoubleType())
def pvalue_overlap(k: pd.Series, n: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, n, left, right)], dtype=float)


@F.pandas_udf(DoubleType())
def pvalue_support(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype=float)


def exact_overlap(k: int, n: int, left: int, right: int) -> float:
    """The same by whole numbers, for small ones."""
    return sum(comb(left, i) * comb(n - left, right - i) for i in range(max(0, k), min(left, right) + 1) if right - i <= n - left) / comb(n, right)
