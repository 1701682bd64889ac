"""Tail probabilities that Spark SQL lacks, as Arrow-batched functions for grouped results, and normal quantiles as an expression."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)) / a
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * c * d
        out = np.where(x <= 0, 0.0, front * h)
    return np.where(flip, 1 - out, out)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) of Student's t; null for null input."""
    tt, d = t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan)
    ok = np.isfinite(tt) & (d > 0)
    out = np.full(len(tt), np.nan)
    out[ok] = beta_fraction(d[ok] / 2, np.full(ok.sum(), 0.5), d[ok] / (d[ok] + tt[ok] ** 2))
    return pd.Series(out).astype(object).where(ok, None)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of the standard normal; null for null input."""
    return pd.Series([None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)) for v in z.astype(object)], dtype=object)


# Wichura's rational approximations to the normal quantile (algorithm AS 241, PPND16), highest power first.
CENTRE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
NEAR_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """The z that the standard normal stays below with probability p, to 1e-15 of its size; null outside (0, 1)."""

    def ratio(parts: tuple[tuple[float, ...], ...], r: Column) -> Column:
        over, under = (reduce(lambda sum_, c: sum_ * r + F.lit(c), own[1:], F.lit(own[0])) for own in parts)
        return over / under

    q = p - F.lit(0.5)
    far = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(far <= 5, ratio(NEAR_TAIL, far - F.lit(1.6))).otherwise(ratio(FAR_TAIL, far - F.lit(5.0)))
    z = F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), z)
