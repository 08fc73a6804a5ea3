"""Baseline regressors as Spark ML pipelines.

Feature preparation: one-hot categorical columns (unknown and null -> all zeros),
numeric columns passed through, then an optional scaler. The linear models are solved from
one table of products (``gram.py``) over features standardised by their population standard
deviation, with scikit-learn's objectives.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (ElementwiseProduct, MinMaxScaler, OneHotEncoder, StandardScaler,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.operators import dictionary, forest, gram
from cohortkit.operators.split import SEED

FEATURES = "features"
FULL_STEP = 1        # its place among the lengths that the SVR tries
NODE_BATCH_MB = 256  # bin counts of the forest that a task holds at a time


def _ship_by_value() -> None:
    # the SVR's per-batch functions travel in the task closure
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


def prepare(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
            scaler: str | None = None) -> PipelineModel:
    """F1 + F2 (+ F4 / F5): fitted feature stages.

    Levels are numbered by a dictionary table, so a vocabulary of any size stays on the
    executors. Unseen values and nulls get the number after the last level, which
    ``OneHotEncoder(dropLast=True)`` drops, so they encode as all zeros
    (``handle_unknown='ignore'``). ``scaler``: None, 'standard' (mean 0, *population*
    std, as scikit-learn), or 'minmax'."""
    stages = []
    idx_cols = [f"{c}__idx" for c in categorical]
    ohe_cols = [f"{c}__ohe" for c in categorical]
    if categorical:
        index = dictionary.OneHotIndex(dictionary.build(train, dict.fromkeys(categorical)), categorical, idx_cols)
        # fitted on one row that holds each column's last index: only the sizes matter
        last = train.sparkSession.createDataFrame([tuple(float(index.sizes[c]) for c in categorical)],
                                                  ", ".join(f"`{c}` double" for c in idx_cols))
        stages += [index, OneHotEncoder(inputCols=idx_cols, outputCols=ohe_cols, dropLast=True,
                                        handleInvalid="error").fit(last)]
    assembler = VectorAssembler(inputCols=ohe_cols + list(numeric),
                                outputCol=FEATURES if scaler is None else "_raw",
                                handleInvalid="keep")
    stages.append(assembler)
    fitted = PipelineModel(stages=stages)
    if scaler is None:
        return fitted
    x = fitted.transform(train)
    if scaler == "standard":
        sc = StandardScaler(inputCol="_raw", outputCol="_ssc", withMean=True, withStd=True).fit(x)
        n = x.count()
        # Spark divides by the sample std; population std = sample std * sqrt((n-1)/n)
        k = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        dim = len(sc.mean)
        stages += [sc, ElementwiseProduct(inputCol="_ssc", outputCol=FEATURES,
                                          scalingVec=Vectors.dense([k] * dim))]
    elif scaler == "minmax":
        stages.append(MinMaxScaler(inputCol="_raw", outputCol=FEATURES).fit(x))
    else:
        raise ValueError(f"unknown scaler {scaler}")
    return PipelineModel(stages=stages)


def fit(kind: str, train: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
        label: str = "audit_c_score", alpha: float | None = None, l1_ratio: float = 0.5,
        seed: int = SEED + 534, **params) -> PipelineModel:
    """Fit one baseline; returns a model whose ``transform`` adds ``prediction``."""
    scaler = "minmax" if kind == "svr" else None
    prep = prepare(train, categorical, numeric, scaler)
    x = prep.transform(train).select(FEATURES, F.col(label).cast("double").alias("label"))
    if kind == "rf":
        # names the forest; its trees are grown by forest.py, and do not depend on the last three
        est = RandomForestRegressor(numTrees=params.get("num_trees", 100), featureSubsetStrategy="all",
                                    maxDepth=params.get("max_depth", 20), maxBins=params.get("max_bins", 64),
                                    minInstancesPerNode=1, bootstrap=True, seed=seed,
                                    maxMemoryInMB=params.get("max_memory_mb", NODE_BATCH_MB), cacheNodeIds=True,
                                    checkpointInterval=10)
        model = forest.ForestModel.train(est, x)
    elif kind in ("linear", "ridge", "elastic"):
        st = gram.statistics(x).get("")
        if st is None:
            raise ValueError("no training row with a label")
        if kind == "elastic":
            solved = gram.elastic_net(st, 1.0 if alpha is None else alpha, l1_ratio, **params)
        else:
            solved, = gram.ridges(st, [0.0 if kind == "linear" else 100.0 if alpha is None else alpha])
        model = gram.LinearModel(*solved)
    elif kind == "svr":
        model = LinearSVRModel.train(x, **params)
    else:
        raise ValueError(f"unknown model kind {kind}")
    return PipelineModel(stages=[*prep.stages, model])


def grid(train: DataFrame, valid: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
         label: str = "audit_c_score", alphas: Sequence[float] = (1e-2, 1e-1, 1, 10, 100, 1e3, 1e4)) -> DataFrame:
    """Ridge penalty search on the validation split -> (alpha, mse) rows. One job sums
    the products of both splits; all penalties and their errors follow from them."""
    prep = prepare(train, categorical, numeric)
    both = train.withColumn("_part", F.lit("train")).unionByName(valid.withColumn("_part", F.lit("valid")))
    parts = gram.statistics(prep.transform(both), FEATURES, label, "_part")
    rows = [(float(a), parts["valid"].squared_error(*m) if "valid" in parts else None)
            for a, m in zip(alphas, gram.ridges(parts["train"], alphas))]
    return train.sparkSession.createDataFrame(rows, "alpha double, mse double")


class LinearSVRModel:
    """Linear epsilon-insensitive support vector regression (scikit-learn's
    ``SVR(kernel='linear')``: C=1, epsilon=0.1).

    Objective: |w|^2 / 2 + C sum max(0, |y - w.x - b| - eps). The hinge is joined by a
    quadratic piece whose width shrinks tenfold at a time; for each width, Newton steps run
    until they settle. The slopes there are the dual variables of the problem: they name a
    point of the dual and with it the duality gap, the most by which the objective can still
    be above the optimum. Fitting ends when the gap is below ``gap`` times the objective;
    ``gap_`` holds what was reached. A width at which the steps do not settle, or a width
    below ``least_width``, raises ``gram.NotConverged``.

    A step is one job as long as its full length is the best one, else two: the losses of all
    lengths come with gradient and curvature at the full one. Sums are made per task, then over
    all of them on the executors, so that what reaches the driver depends on the number of
    features only, and the result does not depend on the partitioning."""

    def __init__(self, w, b: float, gap: float = 0.0):
        self.w = [float(v) for v in w]
        self.b, self.gap_ = float(b), float(gap)
        self.uid = "LinearSVRModel"

    @classmethod
    def train(cls, x: DataFrame, c: float = 1.0, epsilon: float = 0.1, gap: float = 1e-6,
              max_steps: int = 200, least_width: float = 1e-10) -> LinearSVRModel:
        from cohortkit.session import materialise
        x = materialise(x.select(vector_to_array(F.col(FEATURES)).alias("f"), "label"))
        first = x.first()
        if first is None:
            return cls([], 0.0)
        dim = len(first["f"])
        w = np.zeros(dim + 1)
        w[-1] = x.agg(F.percentile_approx("label", 0.5)).first()[0]
        penalty = np.append(np.ones(dim), 0.0)
        lengths = np.append(0.0, 0.5 ** np.arange(10))  # the full step comes at FULL_STEP
        width, reached = 1.0, np.inf
        while width >= least_width:
            damping = 1.0                # added curvature, raised whenever no length of a step helps
            sums = None                  # slope and curvature at w, where the last job has them already
            for _ in range(max_steps):
                if sums is None:
                    sums = _summed(x, _svr_slopes(w, epsilon, width), dim + 1 + (dim + 1) ** 2)
                slope = penalty * w + c * sums[:dim + 1]
                curve = np.diag(penalty + damping) + c * sums[dim + 1:].reshape(dim + 1, dim + 1)
                step = np.linalg.solve(curve, slope)
                tried = w - lengths[:, None] * step
                found = _summed(x, _svr_tried(tried, epsilon, width), len(lengths) + len(sums))
                loss = c * found[:len(lengths)]
                best = int(((penalty * tried ** 2).sum(axis=1) / 2 + loss).argmin())
                w, damping = tried[best], damping * (0.1 if best else 10.0)
                sums = sums if best == 0 else found[len(lengths):] if best == FULL_STEP else None
                if np.abs(slope).max() <= 1e-9 * (1 + np.abs(w).max()) or np.abs(step).max() < 1e-11:
                    break
            else:
                raise gram.NotConverged(f"SVR: steps at width {width} did not settle")
            primal, bound = _svr_gap(x, w, c, epsilon, width, dim)
            reached = (primal - bound) / max(primal, 1e-300)
            if reached <= gap:
                return cls(w[:-1].tolist(), w[-1], reached)
            width /= 10
        raise gram.NotConverged(f"SVR: duality gap {reached} of {gap}")

    def transform(self, df: DataFrame) -> DataFrame:
        feats = vector_to_array(F.col(FEATURES))
        pred = sum((feats[j] * F.lit(self.w[j]) for j in range(len(self.w))), F.lit(self.b))
        return df.withColumn("prediction", pred)


def _summed(x: DataFrame, per_batch, size: int) -> np.ndarray:
    """Element sums of the arrays that ``per_batch`` makes of (features, labels)."""
    def run(batches):
        import numpy as _np
        import pyarrow as _pa
        total = None
        for b in batches:
            if b.num_rows:
                # the features of a batch lie in one flat array
                rows = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                design = _np.column_stack([rows, _np.ones(b.num_rows)])
                part = per_batch(design, b.column("label").to_numpy(zero_copy_only=False).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield _pa.record_batch({"s": _pa.array([total], _pa.list_(_pa.float64()))})

    rows = (x.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v"))
            .groupBy("i").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _svr_slopes(w, eps, width):
    def run(design, y):
        r = y - design @ w
        over = (np.abs(r) - eps) / width
        slope = -design.T @ (np.sign(r) * np.clip(over, 0, 1))
        joint = design[(over > 0) & (over < 1)]
        return np.concatenate([slope, (joint.T @ joint / width).ravel()])
    return run


def _svr_gap(x: DataFrame, w: np.ndarray, c: float, eps: float, width: float, dim: int) -> tuple[float, float]:
    """The objective at ``w`` and the dual value of the slopes there. The intercept makes the
    dual variables add up to zero; what rounding leaves of that sum is charged to the bound."""
    def run(design, y):
        r = y - design @ w
        over = np.maximum(np.abs(r) - eps, 0)
        beta = np.sign(r) * np.clip(over / width, 0, 1)
        return np.concatenate([[over.sum(), beta @ y - eps * np.abs(beta).sum(), np.abs(y).max()], design.T @ beta])

    s = c * _summed(x, run, 3 + dim + 1)
    primal = float(w[:-1] @ w[:-1] / 2 + s[0])
    bound = float(s[1] - s[3:-1] @ s[3:-1] / 2 - abs(s[-1]) * s[2] / c)
    return primal, bound


def _svr_losses(tried, eps, width):
    def run(design, y):
        over = np.maximum(np.abs(y[:, None] - design @ tried.T) - eps, 0)
        return np.where(over < width, over ** 2 / (2 * width), over - width / 2).sum(axis=0)
    return run


def _svr_tried(tried, eps, width):
    """The losses at all tried points, then slope and curvature at that of the full step."""
    losses, slopes = _svr_losses(tried, eps, width), _svr_slopes(tried[FULL_STEP], eps, width)
    return lambda design, y: np.concatenate([losses(design, y), slopes(design, y)])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply fitted stages in order (works with the primal SVR stage too)."""
    for st in model.stages:
        df = st.transform(df)
    return df
