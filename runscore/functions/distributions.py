"""Tail probabilities Spark has no function for.

Applied to aggregated rows only: one row per tested group, never the data.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# send these functions with the tasks, so that workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def _beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df < 1:
        return math.nan
    if math.isinf(t):
        return 0.0
    return _beta_ratio(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(confidence: float, df: float) -> float:
    """t with the given central probability, by bisection."""
    if df < 1:
        return math.nan
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1.0 - confidence:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > 1.0 - confidence:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


@F.pandas_udf(T.DoubleType())
def _t_pvalues(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def _t_criticals(confidence: pd.Series, df: pd.Series) -> pd.Series:
    keys = [(float(c), float(d)) for c, d in zip(confidence, df)]
    known = {key: t_quantile(*key) for key in set(keys)}
    return pd.Series([known[key] for key in keys])


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else math.nan)


def _nan_for_null(value: Column) -> Column:
    """Arrow turns NaN into null on the way back; undo that."""
    return F.coalesce(value, F.lit(math.nan))


def t_pvalue(t: Column, df: Column) -> Column:
    return _nan_for_null(_t_pvalues(t, df))


def t_critical(confidence: Column, df: Column) -> Column:
    return _nan_for_null(_t_criticals(confidence, df))


def normal_two_sided(z: Column) -> Column:
    return _nan_for_null(_normal_two_sided(z))
