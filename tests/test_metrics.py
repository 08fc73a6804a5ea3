"""Rank metrics against O(n^2) brute force."""
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import metrics as M
from cohortkit.operators import prefix


def brute_c(y, p):
    num = den = 0.0
    for i in range(len(y)):
        for j in range(len(y)):
            if y[i] < y[j]:
                den += 1
                num += 1.0 if p[i] < p[j] else 0.5 if p[i] == p[j] else 0.0
    return num / den if den else None


@pytest.mark.parametrize("buckets", [1, 3, None])
def test_c_index_matches_brute_force(spark, buckets):
    rnd = random.Random(5)
    y = [rnd.randint(0, 12) for _ in range(200)]
    p = [round(rnd.random() * 10, 1) for _ in range(200)]
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction double")
    got = M.c_index(df, buckets=buckets).collect()[0]["c_index"]
    assert got == pytest.approx(brute_c(y, p), abs=1e-12)


def test_c_index_no_pairs_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.5)], "label int, prediction double")
    assert M.c_index(df).collect()[0]["c_index"] is None


@pytest.mark.parametrize("buckets", [1, 4, None])
def test_auc_matches_brute_force(spark, buckets):
    rnd = random.Random(9)
    y = [rnd.randint(0, 1) for _ in range(200)]
    s = [round(rnd.random(), 2) for _ in range(200)]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.roc_auc(df, buckets=buckets).collect()[0]["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.3)], "label int, score double")
    r = M.binary(df).collect()[0]
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert r["accuracy"] == pytest.approx(2 / 3)


def test_regression_and_rounded_accuracy(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (3.0, 2.0)], "label double, prediction double")
    r = M.regression(df).collect()[0]
    assert r["mse"] == pytest.approx((0.25 + 0.25 + 1) / 3)
    assert r["rmse"] == pytest.approx(math.sqrt((0.25 + 0.25 + 1) / 3))
    # half to even: 1.5 -> 2 (miss), 2.5 -> 2 (hit), 2.0 -> 2 (miss)
    assert M.rounded_accuracy(df).collect()[0]["rounded_accuracy"] == pytest.approx(1 / 3)


def test_fine_grained_parts(spark):
    df = spark.createDataFrame([([1, 2, 3], [1.0, 2.0, 4.0]), ([0, 0, 1], [0.5, 0.0, 1.0])],
                               "labels array<int>, predictions array<double>")
    r = M.fine_grained(df).collect()[0]
    assert r["individual_mse"] == pytest.approx((1 + 0.25) / 6)
    assert r["mse"] == pytest.approx(((7 - 6) ** 2 + (1.5 - 1) ** 2) / 2)


def test_two_level_prefix_equals_cumsum(spark):
    rnd = random.Random(1)
    rows = [(g, float(v), rnd.randint(1, 5)) for g in ("a", "b") for v in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, v double, c long")
    got = {(r["g"], r["v"]): r["c_before"] for r in prefix.running(df, "v", ["c"], by=["g"], buckets=7).collect()}
    for g in ("a", "b"):
        acc = 0
        for _, v, c in sorted(x for x in rows if x[0] == g):
            assert got[(g, v)] == acc
            acc += c


def test_best_runs_top_k(spark):
    runs = spark.createDataFrame([("r1", 0.5), ("r2", 0.1), ("r3", 0.3), ("r4", 0.1)], "run_id string, loss double")
    assert [r["run_id"] for r in M.best_runs(runs).collect()] == ["r2", "r4", "r3"]


@pytest.mark.parametrize("block_rows,fan", [(10_000, 64), (25, 64), (25, 3), (6, 2)])
def test_c_index_continuous_truth(spark, monkeypatch, block_rows, fan):
    """One block, one level of merges, and several."""
    from cohortkit.operators import concordance
    from cohortkit.operators.concordance import c_index_continuous
    monkeypatch.setattr(concordance, "FAN", fan)
    rnd = random.Random(13)
    y = [round(rnd.random() * 50, 1) for _ in range(240)] + [7.0] * 60       # a hot truth value
    p = [round(rnd.random() * 5, 1) for _ in range(240)] + [rnd.choice([1.0, 2.0]) for _ in range(60)]
    df = spark.createDataFrame(list(zip(y, p)), "label double, prediction double")
    hist = df.groupBy(F.col("label").alias("_y"), F.col("prediction").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    got = c_index_continuous(hist, block_rows=block_rows)
    assert got == pytest.approx(brute_c(y, p), abs=1e-12)


def test_c_index_switches_to_exact_continuous_path(spark):
    rnd = random.Random(21)
    y = [rnd.random() for _ in range(150)]
    p = [round(v + rnd.random() * 0.3, 2) for v in y]
    df = spark.createDataFrame(list(zip(y, p)), "label double, prediction double")
    assert M.c_index(df).collect()[0]["c_index"] == pytest.approx(brute_c(y, p), abs=1e-12)


def test_two_level_running_min_descending(spark):
    rnd = random.Random(8)
    rows = [(g, float(v), float(rnd.randint(0, 1000))) for g in ("a", "b") for v in rnd.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "g string, v double, x double")
    got = {(r["g"], r["v"]): r["x_m"] for r in
           prefix.running(df, "v", ["x"], by=["g"], how="min", inclusive=True, descending=True,
                          buckets=6, suffix="_m").collect()}
    for g in ("a", "b"):
        best = float("inf")
        for _, v, x in sorted((x for x in rows if x[0] == g), key=lambda t: -t[1]):
            best = min(best, x)
            assert got[(g, v)] == best


def test_first_part_mse_per_run(spark):
    """M5: plain MSE on the first column of array predictions, one row per run."""
    df = spark.createDataFrame([("r1", [1.0, 9.0], [2.0, 0.0]), ("r1", [3.0, 9.0], [3.0, 0.0]),
                                ("r2", [0.0, 1.0], [2.0, 5.0])], "run_id string, labels array<double>, preds array<double>")
    x = df.select("run_id", M.first_part("labels").alias("label"), M.first_part("preds").alias("prediction"))
    got = {r["run_id"]: r["mse"] for r in M.regression(x, by=["run_id"]).collect()}
    assert got == pytest.approx({"r1": 0.5, "r2": 4.0})


@pytest.mark.parametrize("block_rows", [200_000, 25])
def test_c_index_by_run_continuous_has_no_run_limit(spark, block_rows):
    """70 runs and a null one, continuous truth; small blocks send large runs another way."""
    from cohortkit.operators.concordance import c_index_groups
    rnd = random.Random(3)
    rows = [(None if g == 70 else f"r{g:02}", round(rnd.random() * 9, 2), round(rnd.random() * 2, 1))
            for g in range(71) for _ in range(40 if g < 2 else 12)] + [("same", 1.0, 0.5), ("same", 1.0, 0.6)]
    df = spark.createDataFrame(rows, "run_id string, label double, prediction double")
    if block_rows == 25:
        hist = df.groupBy("run_id", F.col("label").alias("_y"), F.col("prediction").alias("_p")).agg(
            F.count(F.lit(1)).alias("_n"))
        out = c_index_groups(hist, ["run_id"], block_rows)
    else:
        out = M.c_index(df, by=["run_id"])
    got = {r["run_id"]: r["c_index"] for r in out.collect()}
    assert len(got) == 72 and got["same"] is None
    for run in got:
        y, p = [r[1] for r in rows if r[0] == run], [r[2] for r in rows if r[0] == run]
        assert got[run] == pytest.approx(brute_c(y, p), abs=1e-12)


def test_concordant_weights_past_64_bits():
    """Exact sums where weights are large."""
    import numpy as np
    from cohortkit.operators import concordance as CC
    n = np.array([3_000_000_001, 2_999_999_999, 7], dtype=np.int64)
    w = np.array([2**40 + 1, 2**41 + 3, 5], dtype=np.int64)
    assert CC._dot(n, w) == sum(int(a) * int(b) for a, b in zip(n, w))
    rnd = np.random.default_rng(2)
    for m in (0, 1, 2, 3, 17, 64, 65):
        p, k = rnd.integers(0, 9, m).astype(float), rnd.integers(1, 5, m)
        want = sum(int(k[i] * k[j]) for i in range(m) for j in range(i + 1, m) if p[i] < p[j])
        assert CC._inside(p, k.astype(np.int64)) == want


def test_c_index_plan_has_no_single_partition(spark):
    """Many blocks: every exchange but the last sum of a few numbers is by range or key."""
    from cohortkit.operators import concordance as CC
    hist = spark.range(5000).select(F.lit(0).cast("long").alias("_g"), (F.col("id") * 7919 % 5003).cast("double").alias("_y"),
                                    (F.col("id") * 104729 % 4999).cast("double").alias("_p"), F.lit(1).cast("long").alias("_n"))
    from cohortkit.session import materialise
    h = materialise(hist)
    rows = [(r["_y"], r["_p"]) for r in h.collect()]
    got = CC.concordant(h, block_rows=100).first()["conc"]
    rows.sort()
    import bisect
    seen, total = [], 0
    for _, p in rows:
        total += bisect.bisect_left(seen, p)
        bisect.insort(seen, p)
    assert int(got) == total
    plan = CC.concordant(h, block_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
