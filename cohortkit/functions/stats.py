"""Special functions for p-values.

Spark SQL has no ``erfc`` or regularised incomplete beta. These run as Arrow-batched
pandas UDFs and are only ever applied to *aggregated* tables (one row per feature),
never to person-level rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SQRT2 = math.sqrt(2.0)


def _ship_by_value() -> None:
    # UDF bodies travel inside the task closure, so executors need no install of
    # this package (on a cluster, ``--py-files`` works as well)
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


def _betacf(a: float, b: float, x: float, max_iter: int = 300, eps: float = 1e-15) -> float:
    """Continued fraction for the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def normal_two_sided_p(z: float) -> float:
    """2 * sf(z) for z >= 0, capped at 1."""
    return min(1.0, math.erfc(z / _SQRT2))


# From here on the incomplete beta loses digits (differences of huge log-gammas); the
# normal limit with Fisher's first two correction terms is exact to about 1 / dof**3.
LARGE_DOF = 1e6


def t_two_sided_p(t: float, dof: float) -> float:
    if dof > LARGE_DOF:
        t = abs(t)
        tail = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        c1 = t * (t * t + 1) / 4
        c2 = t * (3 * t**6 - 7 * t**4 - 5 * t * t - 3) / 96
        return min(1.0, normal_two_sided_p(t) + 2 * tail * (c1 / dof + c2 / dof**2))
    return min(1.0, betainc(dof / 2.0, 0.5, dof / (dof + t * t)))


@F.pandas_udf(T.DoubleType())
def _normal_p_udf(z: pd.Series) -> pd.Series:
    out = np.full(len(z), np.nan)
    vals = z.to_numpy(dtype=float, na_value=np.nan)
    for i, v in enumerate(vals):
        if not math.isnan(v):
            out[i] = normal_two_sided_p(v)
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    out = np.full(len(t), np.nan)
    tv = t.to_numpy(dtype=float, na_value=np.nan)
    dv = dof.to_numpy(dtype=float, na_value=np.nan)
    for i in range(len(tv)):
        if not (math.isnan(tv[i]) or math.isnan(dv[i])) and dv[i] > 0:
            out[i] = t_two_sided_p(tv[i], dv[i])
    return pd.Series(out)


def normal_p(z: Column | str) -> Column:
    """Two-sided normal p-value column from a (non-negative) z column; null stays null."""
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z.isNull(), F.lit(None).cast("double")).otherwise(_normal_p_udf(z))


def t_p(t: Column | str, dof: Column | str) -> Column:
    """Two-sided Student-t p-value column; null when either input is null or dof <= 0."""
    t = F.col(t) if isinstance(t, str) else t
    dof = F.col(dof) if isinstance(dof, str) else dof
    return F.when(t.isNull() | dof.isNull() | (dof <= 0), F.lit(None).cast("double")) \
        .otherwise(_t_p_udf(t, dof.cast("double")))
