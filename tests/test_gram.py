"""Sufficient statistics and the solvers on them."""
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortkit.operators import gram


def frame(spark, x, y, part=None):
    cols = [f"x{j}" for j in range(x.shape[1])]
    rows = [(*map(float, r), None if t is None else float(t), str(p)) for r, t, p in zip(x, y, part or ["a"] * len(x))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", label double, part string")
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def test_statistics_by_part_and_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4)) + [1e6, 0, -5e5, 3]
    y = rng.normal(size=400) + 1e5
    part = ["t" if i % 3 else "v" for i in range(400)]
    df = frame(spark, x, list(y), part).repartition(7)
    got = gram.statistics(df, part="part")
    for name in ("t", "v"):
        pick = np.array([p == name for p in part])
        xc, yc = x[pick] - x[pick].mean(0), y[pick] - y[pick].mean()
        assert got[name].n == pick.sum() and got[name].mean == pytest.approx(x[pick].mean(0), rel=1e-12)
        assert got[name].xx == pytest.approx(xc.T @ xc, abs=1e-6) and got[name].xy == pytest.approx(xc.T @ yc, abs=1e-6)
        assert got[name].yy == pytest.approx(yc @ yc, rel=1e-9)
        w = rng.normal(size=4)
        assert got[name].squared_error(w, 2.0) == pytest.approx(np.mean((x[pick] @ w + 2 - y[pick]) ** 2), rel=1e-9)


def test_null_labels_empty_tables_and_constant_features(spark):
    x = np.array([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0], [9.0, 9.0]])
    st = gram.statistics(frame(spark, x, [1.0, 2.0, 4.0, None]))[""]
    coef, b = gram.ridges(st, [0.0])[0]
    assert st.n == 3 and coef == pytest.approx([1.0, 0.0], abs=1e-9) and b == pytest.approx(0.0, abs=1e-9)
    assert gram.statistics(frame(spark, x, [None] * 4)) == {}


def test_least_squares_of_dependent_features_has_least_norm(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(60, 2))
    x = np.column_stack([a, a.sum(axis=1)])
    y = a @ [1.0, 2.0] + 0.3
    coef, b = gram.ridges(gram.statistics(frame(spark, x, list(y)))[""], [0.0])[0]
    assert x @ coef + b == pytest.approx(y, abs=1e-9)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
    assert coef == pytest.approx(w / x.std(0), abs=1e-8)


def test_elastic_net_holds_the_optimality_conditions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)) * [1, 2, 3, 1, 1, 1]
    y = x @ [2.0, -1.0, 0, 0, 0.2, 0] + rng.normal(size=200)
    st = gram.statistics(frame(spark, x, list(y)))[""]
    for alpha, l1 in ((0.1, 0.5), (0.5, 0.9), (1.0, 0.5), (50.0, 0.5)):
        coef, b = gram.elastic_net(st, alpha, l1)
        z = (x - x.mean(0)) / x.std(0)
        w = coef * x.std(0)
        slope = z.T @ (y - x @ coef - b) / 200 - alpha * (1 - l1) * w
        on = np.abs(w) > 0
        assert slope[on] == pytest.approx(alpha * l1 * np.sign(w[on]), abs=1e-5)
        assert (np.abs(slope[~on]) <= alpha * l1 + 1e-9).all()


def test_solver_says_when_it_has_not_settled(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(80, 1))
    x = np.column_stack([a, a + 1e-4 * rng.normal(size=(80, 1))])
    st = gram.statistics(frame(spark, x, list(a[:, 0] + x[:, 1])))[""]
    with pytest.raises(gram.NotConverged):
        gram.elastic_net(st, 1e-6, 0.5, max_sweeps=2)


def test_model_adds_the_prediction(spark):
    df = frame(spark, np.array([[1.0, 2.0], [3.0, 4.0]]), [0.0, 0.0])
    got = [r["prediction"] for r in gram.LinearModel([2.0, -1.0], 0.5).transform(df).collect()]
    assert got == [0.5, 2.5]
    assert gram.LinearModel([], 0.5).transform(df.limit(0).withColumn("features", F.col("features"))).count() == 0
