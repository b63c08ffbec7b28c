"""p-values, batch by batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi_square_tail(x):
    """P(X >= x) for one degree of freedom."""
    return None if x is None else math.erfc(math.sqrt(max(x, 0.0) / 2))


def _tail_of_factorial(x: int) -> float:
    """What Stirling's formula leaves out of log x!."""
    if x < 16:
        return math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) if x else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680.0 * x * x)) / (x * x)) / (x * x)) / x


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without the loss of digits where both are close."""
    gap = x - mean
    if abs(gap) >= 0.1 * (x + mean):
        return x * math.log(x / mean) - gap
    v = gap / (x + mean)
    total, term, k = gap * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """The logarithm of the chance of x of n, by saddle points (Loader 2000): right to the last digits at any size."""
    if n == 0 or x == 0 or x == n:
        return 0.0 if n == 0 else n * (math.log(q) if x == 0 else math.log(p))
    off = _tail_of_factorial(n) - _tail_of_factorial(x) - _tail_of_factorial(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return off + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


#: Tables whose ratios are multiplied in one go, and the relative difference up to which two count as equally likely.
STRIDE, SAME = 4096, 1e-7


class Tables:
    """The 2 x 2 tables with given margins: x of the first row's ``rows`` are in the first column's ``cols``, of n in all."""

    def __init__(self, rows: int, cols: int, n: int):
        self.rows, self.cols, self.n = rows, cols, n
        self.low, self.high = max(0, rows + cols - n), min(rows, cols)
        self.mode = min(max((rows + 1) * (cols + 1) // (n + 2), self.low), self.high)

    def log_chance(self, x: int) -> float:
        p, q = self.cols / self.n, (self.n - self.cols) / self.n
        return _log_binomial(x, self.rows, p, q) + _log_binomial(self.cols - x, self.n - self.rows, p, q) - _log_binomial(self.cols, self.n, p, q)

    def outward(self, x: int) -> float:
        """The chances of x and all tables farther from the mode on its side, over that of x: a product of neighbours' ratios,
        until the terms vanish."""
        step = 1 if x > self.mode or (x == self.mode and self.mode == self.high) else -1
        left = (self.high - x) if step > 0 else (x - self.low)
        total, last, at, rest = 1.0, 1.0, x, self.n - self.rows - self.cols
        while left > 0 and last > total * 1e-18:
            t = at + step * np.arange(min(STRIDE, left), dtype=np.float64)
            up = (self.rows - t) * (self.cols - t) / ((t + 1) * (rest + t + 1)) if step > 0 else t * (rest + t) / ((self.rows - t + 1) * (self.cols - t + 1))
            terms = last * np.cumprod(up)
            total += float(terms.sum())
            last, at, left = float(terms[-1]), at + step * len(t), left - len(t)
        return total

    def first_no_likelier(self, limit: float, near: int, far: int) -> int | None:
        """Of the tables from ``near``, by the mode, to ``far`` the first whose log chance is at most ``limit``."""
        if self.log_chance(far) > limit:
            return None
        step = 1 if far >= near else -1
        a, b = 0, abs(far - near)
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if self.log_chance(near + step * mid) <= limit else (mid + 1, b)
        return near + step * a


def fisher_two_sided(a, b, c, d):
    """Sum of the probabilities of all tables, margins fixed, that are no likelier than this one.

    Chances rise to the mode and fall after it, so these tables are two tails: where they begin is found by bisection, and
    each is summed outward from there by the ratios of neighbours. A table needs a few standard deviations of terms, however
    large its margins are.
    """
    if None in (a, b, c, d):
        return None
    a, b, c, d = int(a), int(b), int(c), int(d)
    t = Tables(a + b, a + c, a + b + c + d)
    if t.low == t.high:
        return 1.0
    limit = t.log_chance(a) + math.log1p(SAME)
    if t.log_chance(t.mode) <= limit:
        return 1.0
    total = 0.0
    for far in (t.low, t.high):
        if far != t.mode and (x := t.first_no_likelier(limit, t.mode, far)) is not None:
            total += math.exp(t.log_chance(x)) * t.outward(x)
    return min(1.0, total)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def correlation_tail(r, n):
    """Two-sided p of a correlation of n pairs by the t distribution."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def _batched(scalar):
    """A vectorised function of columns from one of numbers; a missing number gives none."""

    def each(*columns: pd.Series) -> pd.Series:
        rows = zip(*(c.astype(object).where(c.notna(), None) for c in columns), strict=True)
        return pd.Series([scalar(*row) for row in rows], dtype="float64")

    return each


def _one(x: pd.Series) -> pd.Series:
    return _batched(chi_square_tail)(x)


def _two(r: pd.Series, n: pd.Series) -> pd.Series:
    return _batched(correlation_tail)(r, n)


def _four(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _batched(fisher_two_sided)(a, b, c, d)


chi_square_p = F.pandas_udf(_one, DoubleType())
fisher_p = F.pandas_udf(_four, DoubleType())
correlation_p = F.pandas_udf(_two, DoubleType())
