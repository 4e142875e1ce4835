"""Statistical functions. Closed forms are Spark expressions; the rest are small vectorised helpers in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gamma = np.vectorize(math.lgamma, otypes=[float])
    return gamma(a) + gamma(b) - gamma(a + b)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), in the tail form for small values."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (z > 0) & (z < 1)
    z = np.where(inside, z, 0.5)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 400):
        for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            value = value * change
        if np.all(np.abs(change - 1) < 1e-15):
            break
    front = np.exp(p * np.log(z) + q * np.log1p(-z) - _log_beta(p, q)) / p
    out = np.where(inside, front * value, np.where(np.where(flip, 1 - x, x) <= 0, 0.0, 1.0))
    return np.where(flip, 1 - out, out)


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's t; keeps its relative accuracy far out."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    half = 0.5 * incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    half = np.where(np.isinf(t), 0.0, half)
    return np.where(np.isnan(t), np.nan, np.where(t >= 0, half, 1 - half))


def t_critical(alpha: float, df: float) -> float:
    """The value that Student's t exceeds with probability ``alpha``."""
    low, high = -1e6, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        if t_tail(np.array([middle]), np.array([df]))[0] > alpha:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def exact_upper(errors: np.ndarray, n: np.ndarray, gamma: float) -> np.ndarray:
    """One-sided Clopper-Pearson upper bound: the p with P(Binomial(n, p) <= errors) = gamma."""
    errors, n = np.asarray(errors, float), np.asarray(n, float)
    low, high = np.zeros_like(n), np.ones_like(n)
    for _ in range(60):
        middle = (low + high) / 2
        tail = incomplete_beta(np.maximum(n - errors, 1e-9), errors + 1, 1 - middle)
        low, high = np.where(tail > gamma, middle, low), np.where(tail > gamma, high, middle)
    out = np.where(errors == n, 1.0, np.where(errors == 0, 1 - gamma ** (1 / np.maximum(n, 1)), (low + high) / 2))
    return np.where((n < 1) | (errors < 0) | (errors > n), np.nan, out)


def t_sf(t: Column, df: Column) -> Column:
    """P(T > t) of Student's t."""

    @F.pandas_udf(DoubleType())
    def tail(values: pd.Series, degrees: pd.Series) -> pd.Series:
        return pd.Series(t_tail(values.to_numpy(float), degrees.to_numpy(float)))

    return tail(t, df)


def exact_bound(errors: Column, n: Column, gamma: float) -> Column:
    """Clopper-Pearson upper bound of a share; null without cases."""

    @F.pandas_udf(DoubleType())
    def bound(k: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(exact_upper(k.to_numpy(float), size.to_numpy(float), gamma))

    closed = F.when(errors == 0, 1 - F.pow(F.lit(gamma), 1 / n)).when(errors == n, F.lit(1.0)).otherwise(bound(errors.cast("double"), n.cast("double")))
    return F.when(n >= 1, closed)


def sample_sd(value: Column) -> Column:
    """Sample standard deviation as an aggregate: exactly 0 for equal values and for fewer than two."""
    return F.when(F.max(value) == F.min(value), F.lit(0.0)).otherwise(F.coalesce(F.stddev_samp(value), F.lit(0.0)))


def interval(value: Column, gamma: float) -> Column:
    """Percentile interval [gamma/2, 1 - gamma/2] as an aggregate, linear between neighbours."""
    return F.percentile(value, F.array(F.lit(gamma / 2), F.lit(1 - gamma / 2)))
