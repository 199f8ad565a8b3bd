"""Upper-tail probabilities. They run on aggregated rows only (one per test), as Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front with guarded terms."""
    tiny = 1e-300
    guard = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        d, c = 1.0 / guard(1.0 + even * d), guard(1.0 + even / c)
        total *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        d, c = 1.0 / guard(1.0 + odd * d), guard(1.0 + odd / c)
        total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_share(df / 2.0, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared: series below the mean, continued fraction above."""
    if x <= 0.0:
        return 1.0
    a, half = df / 2.0, x / 2.0
    front = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1.0
            term *= half / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = half + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def _apply(fn, *series: pd.Series) -> pd.Series:
    return pd.Series(
        [None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*series)], dtype="float64"
    )


def p_of_t(t, df):
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return _apply(t_tail, t, df)

    return p(t, df)


def p_of_z(z):
    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return _apply(normal_tail, z)

    return p(z)


def p_of_chi2(x, df):
    @F.pandas_udf("double")
    def p(x: pd.Series, df: pd.Series) -> pd.Series:
        return _apply(chi2_tail, x, df)

    return p(x, df)
