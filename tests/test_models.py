"""Penalised linear baselines equal the scikit-learn objective (closed form in numpy)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import models as MD


def _data(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 3.0, 0.5] + [0.0, 2.0, -1.0]
    y = x @ [1.5, -0.7, 2.0] + rng.normal(size=n) * 0.8 + 4.0
    rows = [(float(a), float(b), float(c), float(t), "train") for (a, b, c), t in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y double, split string")


def _standardise(x):
    return (x - x.mean(0)) / x.std(0)  # population std, as scikit-learn's StandardScaler


def _coef(model, df, x):
    pred = np.array([r["prediction"] for r in MD.predict(model, df).select("prediction").collect()])
    return pred


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_ridge_matches_closed_form(spark, alpha):
    x, y, df = _data(spark)
    z = _standardise(x)
    zc, yc = z - z.mean(0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(3), zc.T @ yc)
    want = z @ w + (y.mean() - z.mean(0) @ w)
    m = MD.fit("ridge", df, [], ["a", "b", "c"], label="y", alpha=alpha)
    assert _coef(m, df, x) == pytest.approx(want, abs=1e-6)


def test_ols_matches_lstsq(spark):
    x, y, df = _data(spark, seed=1)
    xa = np.c_[x, np.ones(len(x))]
    want = xa @ np.linalg.lstsq(xa, y, rcond=None)[0]
    m = MD.fit("linear", df, [], ["a", "b", "c"], label="y")
    assert _coef(m, df, x) == pytest.approx(want, abs=1e-6)


def test_onehot_unknown_is_all_zero(spark):
    train = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0)], "g string, v double, y double")
    prep = MD.prepare(train, ["g"], ["v"])
    test = spark.createDataFrame([("z", 5.0, 0.0), (None, 6.0, 0.0)], "g string, v double, y double")
    feats = [r["features"].toArray().tolist() for r in prep.transform(test).collect()]
    assert feats == [[0.0, 0.0, 5.0], [0.0, 0.0, 6.0]]


def test_forest_bounds_its_bin_counts(spark, monkeypatch):
    """Four tasks of an executor hold at most 1 GB of bin counts, and the size of the node
    batches changes no tree."""
    x, y, df = _data(spark, n=60, seed=5)
    made, forest = [], MD.RandomForestRegressor
    monkeypatch.setattr(MD, "RandomForestRegressor", lambda **k: made.append(k) or forest(**k))
    df = df.coalesce(1)
    small, usual = (MD.fit("rf", df, [], ["a", "b", "c"], label="y", num_trees=2, **k)
                    for k in ({"max_memory_mb": 0}, {}))
    assert 0 < made[1]["maxMemoryInMB"] <= 256
    assert small.stages[-1].totalNumNodes == usual.stages[-1].totalNumNodes > 20
    assert _coef(small, df, x) == pytest.approx(_coef(usual, df, x), abs=1e-9)


def test_svr_fits_linear_signal(spark):
    x, y, df = _data(spark, seed=2)
    m = MD.fit("svr", df, [], ["a", "b", "c"], label="y")
    pred = _coef(m, df, x)
    assert np.mean((pred - y) ** 2) < 2.0 * np.var(y - (np.c_[x, np.ones(len(x))] @ np.linalg.lstsq(
        np.c_[x, np.ones(len(x))], y, rcond=None)[0])) + 0.5


def test_svr_does_not_depend_on_partitions(spark):
    _, _, df = _data(spark, n=200, seed=4)
    fits = [MD.fit("svr", df.repartition(k), [], ["a", "b", "c"], label="y").stages[-1] for k in (1, 40)]
    assert fits[0].w == pytest.approx(fits[1].w, abs=1e-6) and fits[0].b == pytest.approx(fits[1].b, abs=1e-6)


def _svr_dual(z, y, c=1.0, eps=0.1, sweeps=4000):
    """Best dual value by pairwise coordinate ascent over beta with sum zero: a lower bound
    of the objective that does not come from the fitted model."""
    n = len(y)
    beta, w = np.zeros(n), np.zeros(z.shape[1])
    rng = np.random.default_rng(1)
    for _ in range(sweeps):
        i, j = rng.integers(0, n, 2)
        if i == j:
            continue
        d = z[i] - z[j]
        q = d @ d
        if q < 1e-12:
            continue
        lo, hi = max(-c - beta[i], beta[j] - c), min(c - beta[i], beta[j] + c)
        knots = sorted({lo, hi, *(t for t in (-beta[i], beta[j]) if lo < t < hi)})
        value = lambda t: ((y[i] - y[j] - d @ w) * t - q * t * t / 2
                           - eps * (abs(beta[i] + t) + abs(beta[j] - t)))
        tries = list(knots)
        for a, b in zip(knots, knots[1:]):
            mid = (a + b) / 2
            t = (y[i] - y[j] - d @ w - eps * (np.sign(beta[i] + mid) - np.sign(beta[j] - mid))) / q
            tries.append(min(max(t, a), b))
        t = max(tries, key=value)
        beta[i] += t
        beta[j] -= t
        w += t * d
    return beta @ y - eps * np.abs(beta).sum() - w @ w / 2


def test_svr_reaches_the_optimum(spark):
    """The stated gap holds: no dual point lies above the objective, and a plain dual solver
    comes up to it."""
    x, y, df = _data(spark, n=40, seed=6)
    m = MD.fit("svr", df, [], ["a", "b", "c"], label="y").stages[-1]
    z = (x - x.min(0)) / (x.max(0) - x.min(0))
    at = (np.array(m.w) ** 2).sum() / 2 + np.maximum(np.abs(y - z @ m.w - m.b) - 0.1, 0).sum()
    assert 0 <= m.gap_ + 1e-12 and m.gap_ <= 1e-6
    dual = _svr_dual(z, y, sweeps=200_000)
    assert dual <= at + 1e-9 and at - dual <= 2e-6 * at


def test_svr_says_when_it_has_not_settled(spark):
    from cohortkit.operators import gram
    _, _, df = _data(spark, n=60, seed=7)
    with pytest.raises(gram.NotConverged):
        MD.fit("svr", df, [], ["a", "b", "c"], label="y", max_steps=1)


def _enet_cd(z, y, alpha, l1, iters=5000):
    """scikit-learn's ElasticNet objective by coordinate descent (centred, unpenalised intercept)."""
    n, d = z.shape
    zc, yc = z - z.mean(0), y - y.mean()
    w = np.zeros(d)
    for _ in range(iters):
        for j in range(d):
            r = yc - zc @ w + zc[:, j] * w[j]
            rho = zc[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / ((zc[:, j] ** 2).sum() / n + alpha * (1 - l1))
    return w, y.mean() - z.mean(0) @ w


def test_elastic_net_matches_coordinate_descent(spark):
    x, y, df = _data(spark, seed=3)
    z = _standardise(x)
    w, b = _enet_cd(z, y, 1.0, 0.5)
    m = MD.fit("elastic", df, [], ["a", "b", "c"], label="y", alpha=1.0, l1_ratio=0.5)
    assert _coef(m, df, x) == pytest.approx(z @ w + b, abs=1e-4)


def test_ridge_grid_matches_closed_form_validation_mse(spark):
    x, y, df = _data(spark, n=240, seed=5)
    tr, va = slice(0, 180), slice(180, 240)
    rows = [(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)]
    train = spark.createDataFrame(rows[tr], "a double, b double, c double, y double")
    valid = spark.createDataFrame(rows[va], "a double, b double, c double, y double")
    got = {r["alpha"]: r["mse"] for r in MD.grid(train, valid, [], ["a", "b", "c"], label="y",
                                                 alphas=(0.1, 10.0, 1000.0)).collect()}
    mu, sd = x[tr].mean(0), x[tr].std(0)
    zt, zv = (x[tr] - mu) / sd, (x[va] - mu) / sd
    for alpha, mse in got.items():
        zc, yc = zt - zt.mean(0), y[tr] - y[tr].mean()
        w = np.linalg.solve(zc.T @ zc + alpha * np.eye(3), zc.T @ yc)
        pred = zv @ w + (y[tr].mean() - zt.mean(0) @ w)
        assert mse == pytest.approx(np.mean((pred - y[va]) ** 2), rel=1e-6)


def test_svr_step_takes_one_pass_when_its_full_length_is_best(spark, monkeypatch):
    _, _, df = _data(spark, n=200, seed=4)
    passes, solved = [], []
    summed, solve = MD._summed, np.linalg.solve
    monkeypatch.setattr(MD, "_summed", lambda *a: passes.append(1) or summed(*a))
    monkeypatch.setattr(np.linalg, "solve", lambda *a: solved.append(1) or solve(*a))
    MD.fit("svr", df, [], ["a", "b", "c"], label="y")
    assert len(solved) > 10 and len(passes) < 1.7 * len(solved)  # two passes a step before
