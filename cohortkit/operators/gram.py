"""Linear models from sufficient statistics.

One pass sums the products of (1, features, label) per part of the table (e.g. per split);
each task adds up its rows, and row i of all tasks' tables is added up on the executors. A
part is then (d + 2)^2 numbers, whatever the row count: d, the number of features, is what
must be small (a few thousand). Every model and every penalty is solved from them, and the
squared error of a model on another part is read off that part's statistics, so a whole
penalty search is one job.

Sums are taken around the first row's values, which keeps the centred products exact where a
column is far from zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


class NotConverged(RuntimeError):
    """A solver reached its step limit before its stated gap."""


@dataclass
class Statistics:
    """Row count, means, and centred products of the features ``xx``, with the label ``xy``
    and of the label ``yy``."""
    n: float
    mean: np.ndarray
    label: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @property
    def scale(self) -> np.ndarray:
        """Population standard deviation; 1 for a constant feature (it is centred to zero)."""
        s = np.sqrt(np.maximum(np.diag(self.xx), 0) / max(self.n, 1))
        return np.where(s > 1e-12 * np.maximum(1, np.abs(self.mean)), s, 1.0)

    def squared_error(self, coef: np.ndarray, intercept: float) -> float:
        """Mean squared error on this part of ``x @ coef + intercept``."""
        off = self.label - self.mean @ coef - intercept
        return float((self.yy - 2 * self.xy @ coef + coef @ self.xx @ coef) / self.n + off * off)


def _products(shift: np.ndarray):
    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for part, x in pdf.groupby("part", dropna=False):
                rows = np.column_stack([np.ones(len(x)), np.stack(x["f"].to_numpy()), x["label"].to_numpy(dtype=float)]) - shift
                sums[part] = sums.get(part, 0) + rows.T @ rows
        for part, m in sums.items():
            yield pd.DataFrame({"part": part, "i": np.arange(len(m)), "row": list(m)})
    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": pdf["part"].head(1), "i": pdf["i"].head(1), "row": [np.sum(np.stack(pdf["row"].to_numpy()), axis=0)]})


def statistics(df: DataFrame, features: str = "features", label: str = "label", part: str | None = None) -> dict[str, Statistics]:
    """Statistics of every part (one named '' without ``part``) in one job over the rows
    that have a label."""
    x = df.where(F.col(label).isNotNull()).select(
        vector_to_array(F.col(features)).alias("f"), F.col(label).cast("double").alias("label"),
        (F.col(part).cast("string") if part else F.lit("")).alias("part"))
    first = x.first()
    if first is None:
        return {}
    shift = np.concatenate([[0.0], first["f"], [first["label"]]])
    schema = "part string, i long, row array<double>"
    rows = x.mapInPandas(_products(shift), schema).groupBy("part", "i").applyInPandas(_added, schema).collect()
    out = {}
    for name in {r["part"] for r in rows}:
        m = np.array([r["row"] for r in sorted((r for r in rows if r["part"] == name), key=lambda r: r["i"])])
        n, s = m[0, 0], m[0]
        centred = m - np.outer(s, s) / n
        mean = shift + s / n
        out[name] = Statistics(n, mean[1:-1], mean[-1], centred[1:-1, 1:-1], centred[1:-1, -1], float(centred[-1, -1]))
    return out


def _scaled(st: Statistics) -> tuple[np.ndarray, np.ndarray]:
    s = st.scale
    return st.xx / np.outer(s, s), st.xy / s


def _unscaled(st: Statistics, w: np.ndarray) -> tuple[np.ndarray, float]:
    coef = w / st.scale
    return coef, float(st.label - st.mean @ coef)


def ridges(st: Statistics, alphas: Sequence[float]) -> list[tuple[np.ndarray, float]]:
    """For each penalty the minimum of |y - Xw|^2 + alpha |w|^2 over standardised features,
    from one decomposition. Alpha 0 is least squares of least norm."""
    g, q = _scaled(st)
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    floor = values.max(initial=0.0) * len(values) * np.finfo(float).eps
    turned = vectors.T @ q
    out = []
    for a in alphas:
        usable = values + a > (floor if a == 0 else 0)
        w = vectors @ np.where(usable, turned / np.where(usable, values + a, 1.0), 0.0)
        out.append(_unscaled(st, w))
    return out


def elastic_net(st: Statistics, alpha: float = 1.0, l1_ratio: float = 0.5, gap: float = 1e-12,
                max_sweeps: int = 100_000) -> tuple[np.ndarray, float]:
    """Minimum of |y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) |w|^2 / 2 over
    standardised features, by coordinate descent on the products. It ends when the duality
    gap, the most by which the objective can still fall, is below ``gap`` times that of
    w = 0; reaching ``max_sweeps`` before raises."""
    g, q = _scaled(st)
    a, b = alpha * l1_ratio * st.n, alpha * (1 - l1_ratio) * st.n
    w = np.zeros(len(q))
    for _ in range(max_sweeps):
        for j in range(len(w)):
            if g[j, j] + b > 0:
                free = q[j] - g[j] @ w + g[j, j] * w[j]
                w[j] = np.sign(free) * max(abs(free) - a, 0.0) / (g[j, j] + b)
        # the penalised residual, scaled into the dual's feasible set, bounds the optimum
        left = q - g @ w - b * w
        rest = max(st.yy - 2 * w @ q + w @ g @ w, 0.0) + b * w @ w
        fit = st.yy - w @ q
        most = np.abs(left).max(initial=0.0)
        shrink = min(1.0, a / most) if most > 0 else 1.0
        if rest * (1 + shrink ** 2) / 2 + a * np.abs(w).sum() - shrink * fit <= gap * max(st.yy / 2, 1e-300):
            return _unscaled(st, w)
    raise NotConverged(f"elastic net: duality gap above {gap} after {max_sweeps} sweeps")


class LinearModel:
    """``prediction`` = features . coef + intercept, one array expression per row."""

    def __init__(self, coef, intercept: float, features: str = "features"):
        self.coef, self.intercept, self.features = np.asarray(coef, dtype=float), float(intercept), features
        self.uid = "LinearModel"

    def transform(self, df: DataFrame) -> DataFrame:
        terms = F.zip_with(vector_to_array(F.col(self.features)), F.lit(self.coef.tolist()) if len(self.coef) else F.array(),
                           lambda x, w: x * w)
        return df.withColumn("prediction", F.aggregate(terms, F.lit(self.intercept), lambda s, t: s + t))
