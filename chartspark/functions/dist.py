"""Tail probabilities and quantiles, as plain functions and as column functions for small result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS, TINY = 1e-15, 1e-300


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * EPS:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * scale
    b = x + 1 - a
    c, d = 1.0 / TINY, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Lower regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or TINY)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1 + num * d or TINY)
            c = 1 + num / c or TINY
            h *= d * c
        if abs(d * c - 1) < EPS:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_tail(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def t_quantile(p: float, df: float) -> float:
    """Quantile for p above one half, by bisection on the two-sided tail."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 2 * (1 - p):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2x2 table: hypergeometric mass of all tables no likelier than the seen one."""
    row, col, n = a + b, a + c, a + b + c + d
    lf = math.lgamma

    def log_choose(n_: int, k: int) -> float:
        return lf(n_ + 1) - lf(k + 1) - lf(n_ - k + 1)

    def mass(x: int) -> float:
        return log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col)

    seen = mass(a)
    return min(1.0, math.fsum(
        math.exp(mass(x)) for x in range(max(0, col - (n - row)), min(row, col) + 1) if mass(x) <= seen + 1e-7
    ))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_tail(a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else normal_two_sided(a) for a in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def probit(p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else normal_quantile(a) for a in p], dtype="float64")
