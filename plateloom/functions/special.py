"""Distribution functions in numpy: normal, t, F, chi-squared; and Arrow UDFs of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive arguments."""
    x = np.asarray(x, float)
    y = np.where(x < 0.5, 1 - x, x) - 1
    series = _LANCZOS[0] + sum(c / (y + i) for i, c in enumerate(_LANCZOS[1:], 1))
    t = y + 7.5
    out = 0.5 * math.log(2 * math.pi) + (y + 0.5) * np.log(t) - t + np.log(series)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x < 0.5, np.log(math.pi / np.abs(np.sin(math.pi * x))) - out, out)


def beta_regularised(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(~(np.abs(step - 1) > 1e-16)):
            break
    out = np.where(z <= 0, 0.0, front * h)
    out = np.where(swap, 1 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(a * np.log(x) - x - log_gamma(a))
    low = x < a + 1
    z = np.where(low, x, 0.0)
    term, total = 1 / a, 1 / a
    for n in range(1, 2000):
        term = term * z / (a + n)
        total = total + term
        if np.all(~(np.abs(term) > np.abs(total) * 1e-17)):
            break
    z = np.where(low, a + 2, x)
    b = z + 1 - a
    c, d = np.full_like(z, 1e300), 1 / b
    h = d
    for n in range(1, 2000):
        top = -n * (n - a)
        b = b + 2
        d = 1 / np.where(np.abs(top * d + b) < 1e-300, 1e-300, top * d + b)
        c = b + top / c
        h = h * c * d
        if np.all(~(np.abs(c * d - 1) > 1e-16)):
            break
    return np.where(x <= 0, 1.0, np.where(low, 1 - front * total, front * h))


def t_upper(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * beta_regularised(df / 2, 0.5, df / (df + t * t))
    return np.where(np.isnan(t) | np.isnan(df), np.nan, np.where(t > 0, half, 1 - half))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isnan(t) | np.isnan(df), np.nan, beta_regularised(df / 2, 0.5, df / (df + t * t)))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f <= 0, 1.0, beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    x, df = np.asarray(x, float), np.asarray(df, float)
    return np.where(np.isnan(x) | np.isnan(df), np.nan, gamma_upper(df / 2, x / 2))


def normal_upper(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    half = 0.5 * chi2_upper(z * z, np.ones_like(z))
    return np.where(z > 0, half, 1 - half)


def _column(function, *args):
    """A distribution function of columns, in Arrow batches; built where it is used, as workers import this module too."""

    @F.pandas_udf("double")
    def apply(*values: pd.Series) -> pd.Series:
        return pd.Series(function(*(v.to_numpy(float) for v in values)))

    return apply(*args)


def t_two_sided_udf(t, df):
    return _column(t_two_sided, t, df)


def chi2_upper_udf(x, df):
    return _column(chi2_upper, x, df)


def f_upper_udf(f, d1, d2):
    return _column(f_upper, f, d1, d2)
