"""Tail probabilities for columns of test statistics.

The numeric part is NumPy on Arrow batches of statistics (one row per model
term, never raw data); Spark decides how those batches are spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_LANCZOS_G = 7.0
# Lanczos coefficients for g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x):
    """log of the gamma function for x > 0."""
    x = np.asarray(x, dtype=float) - 1.0
    series = np.full_like(x, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + c / (x + i)
    t = x + _LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(series)


def _shifted(x, order, tail):
    # recurrence up to x >= 8, asymptotic series there
    x = np.asarray(x, dtype=float).copy()
    total = np.zeros_like(x)
    while np.any(x < 8):
        low = x < 8
        total = total + np.where(low, 1.0 / x ** (order + 1), 0.0)
        x = np.where(low, x + 1.0, x)
    return x, total, tail(x)


def digamma(x):
    x, total, tail = _shifted(
        x, 0,
        lambda z: np.log(z) - 0.5 / z - 1 / (12 * z**2) + 1 / (120 * z**4)
        - 1 / (252 * z**6) + 1 / (240 * z**8),
    )
    return tail - total


def trigamma(x):
    x, total, tail = _shifted(
        x, 1,
        lambda z: 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5)
        + 1 / (42 * z**7) - 1 / (30 * z**9),
    )
    return tail + total


def inverse_trigamma(value: float) -> float:
    """x with trigamma(x) = value, by bisection on log x."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(low * high)
        if float(trigamma(np.array([mid]))[0]) > value:
            low = mid
        else:
            high = mid
    return math.sqrt(low * high)


def _beta_fraction(a, b, x):
    # modified Lentz evaluation of the continued fraction, which settles after a few times sqrt(max(a, b)) terms
    rounds = 300 + int(20 * math.sqrt(float(np.max(np.maximum(a, b), initial=1.0))))
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def regularized_beta(a, b, x):
    """I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(
        log_gamma(a + b) - log_gamma(a) - log_gamma(b)
        + a * np.log(inner) + b * np.log1p(-inner)
    )
    flip = inner > (a + 1.0) / (a + b + 2.0)
    aa, bb = np.where(flip, b, a), np.where(flip, a, b)
    xx = np.where(flip, 1.0 - inner, inner)
    value = front * _beta_fraction(aa, bb, xx) / aa
    value = np.where(flip, 1.0 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def upper_gamma(a, x):
    """Q(a, x), the upper regularised incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    safe = np.maximum(x, 1e-300)
    scale = np.exp(a * np.log(safe) - safe - log_gamma(a))
    term = 1.0 / a
    series = term.copy()
    # terms die out after a few times sqrt(a)
    rounds = 2000 + int(20 * math.sqrt(float(np.max(a, initial=1.0))))
    for n in range(1, rounds):
        term = term * safe / (a + n)
        series = series + term
        if np.all(np.abs(term) <= 1e-16 * np.abs(series)):
            break
    tiny = 1e-300
    b = safe + 1.0 - a
    c = np.full_like(safe, 1 / tiny)
    d = 1.0 / np.where(np.abs(b) < tiny, tiny, b)
    h = d.copy()
    for i in range(1, rounds):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1.0)[x >= a + 1] < 1e-15):
            break
    out = np.where(x < a + 1.0, 1.0 - scale * series, scale * h)
    return np.where(x <= 0, 1.0, out)


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return regularized_beta(df / 2.0, 0.5, df / (df + t * t))


def t_upper_quantile(p, df):
    """t >= 0 whose two-sided tail probability is p, by bisection to rounding; infinite for p <= 0."""
    p, df = np.asarray(p, dtype=float), np.asarray(df, dtype=float)
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(1100):  # doubling reaches every double
        short = (t_two_sided(high, df) > p) & np.isfinite(high)
        if not short.any():
            break
        with np.errstate(over="ignore"):
            high = np.where(short, 2 * high, high)
    while True:
        middle = (low + high) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return np.where(p <= 0, np.inf, middle)
        above = t_two_sided(middle, df) > p
        low, high = np.where(open_ & above, middle, low), np.where(open_ & ~above, middle, high)


def f_upper(f, df1, df2):
    f = np.asarray(f, dtype=float)
    return regularized_beta(np.asarray(df2) / 2.0, np.asarray(df1) / 2.0, df2 / (df2 + df1 * f))


def chi2_upper(x, df):
    return upper_gamma(np.asarray(df, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


def normal_two_sided(z):
    z = np.asarray(z, dtype=float)
    return chi2_upper(z * z, np.ones_like(z))


def _batchwise(fn):
    def run(*series: pd.Series) -> pd.Series:
        frame = pd.concat([s.astype("float64") for s in series], axis=1)
        ok = np.isfinite(frame.to_numpy()).all(axis=1)
        out = np.full(len(frame), np.nan)
        if ok.any():
            out[ok] = fn(*[frame.iloc[:, i].to_numpy()[ok] for i in range(frame.shape[1])])
        return pd.Series(out)  # NaN leaves the batch as NULL

    return run


def _positive_df(fn):
    def guarded(stat, *dfs):
        good = np.all([d > 0 for d in dfs], axis=0)
        out = np.full(stat.shape, np.nan)
        if good.any():
            out[good] = fn(stat[good], *[d[good] for d in dfs])
        return out

    return guarded


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic; NULL where the statistic is."""
    run = _batchwise(_positive_df(t_two_sided))

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return run(t, df)

    return p(t.cast("double"), df.cast("double"))


def t_quantile(p: Column, df: Column) -> Column:
    """t >= 0 with two-sided tail probability p; NULL where p is not above 0."""
    run = _batchwise(lambda p, df: np.where((p > 0) & (df > 0), t_upper_quantile(np.clip(p, 1e-300, 1.0), np.where(df > 0, df, 1.0)), np.nan))

    @F.pandas_udf("double")
    def quantile(p: pd.Series, df: pd.Series) -> pd.Series:
        return run(p, df)

    return quantile(p.cast("double"), df.cast("double"))


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    run = _batchwise(_positive_df(f_upper))

    @F.pandas_udf("double")
    def p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return run(f, df1, df2)

    return p(f.cast("double"), df1.cast("double"), df2.cast("double"))


def chi2_p_value(x: Column, df: Column) -> Column:
    run = _batchwise(_positive_df(chi2_upper))

    @F.pandas_udf("double")
    def p(x: pd.Series, df: pd.Series) -> pd.Series:
        return run(x, df)

    return p(x.cast("double"), df.cast("double"))


def normal_p_value(z: Column) -> Column:
    run = _batchwise(normal_two_sided)

    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return run(z)

    return p(z.cast("double"))
