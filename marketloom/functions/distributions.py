"""Tail probabilities for test statistics.

Spark has no distribution functions, so these run as Arrow batches over NumPy. They are applied to one
row per test, never to raw observations.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, element-wise."""
    x, a, b = (np.array(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1.0) / (a + b + 2.0)
    x = np.where(flip, 1.0 - x, x)
    a, b = np.where(flip, b, a), np.where(flip, a, b)
    lbeta = np.array([math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q) for p, q in zip(a.ravel(), b.ravel())]).reshape(a.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - lbeta) / a
        tiny = 1e-300
        c = np.ones_like(x)
        d = 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        frac = d.copy()
        for k in range(1, 400):
            for num in (
                k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)),
                -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)),
            ):
                d = 1.0 + num * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                frac = frac * c * d
    out = np.where(x <= 0.0, 0.0, front * frac)
    return np.where(flip, 1.0 - out, out)


def _clean(v: np.ndarray, index) -> pd.Series:
    return pd.Series(np.clip(v, 0.0, 1.0), index=index).where(~np.isnan(v), None).astype("float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    """P(|T| >= |t|) with `dof` degrees of freedom."""
    tv, nu = t.to_numpy(float), dof.to_numpy(float)
    ok = ~(np.isnan(tv) | np.isnan(nu)) & (nu > 0)
    out = np.full(len(tv), np.nan)
    out[ok] = beta_cdf(nu[ok] / (nu[ok] + tv[ok] ** 2), nu[ok] / 2.0, np.full(ok.sum(), 0.5))
    return _clean(out, t.index)


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F >= f)."""
    fv, a, b = f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)
    ok = ~(np.isnan(fv) | np.isnan(a) | np.isnan(b)) & (b > 0)
    out = np.full(len(fv), np.nan)
    out[ok] = beta_cdf(b[ok] / (b[ok] + a[ok] * fv[ok]), b[ok] / 2.0, a[ok] / 2.0)
    return _clean(out, f.index)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z >= z)."""
    out = np.array([math.nan if math.isnan(x) else 0.5 * math.erfc(x / math.sqrt(2.0)) for x in z.to_numpy(float)])
    return _clean(out, z.index)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inv = NormalDist().inv_cdf
    return pd.Series([inv(x) if 0.0 < x < 1.0 else None for x in p.to_numpy(float)], index=p.index, dtype="float64")
