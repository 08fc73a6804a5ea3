"""Screen statistics against O(n^2) brute force on small hand-made data."""
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortkit.functions import stats
from cohortkit.operators import screen as SC


def brute_mwu(x, y):
    n1, n2 = len(x), len(y)
    u1 = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in x for b in y)
    u = max(u1, n1 * n2 - u1)
    vals = x + y
    n = n1 + n2
    counts = {}
    for v in vals:
        counts[v] = counts.get(v, 0) + 1
    ties = sum(t ** 3 - t for t in counts.values())
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return u, None, 1.0
    z = (u - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
    return u, z, min(1.0, math.erfc(z / math.sqrt(2)))


def hist_df(spark, feats):
    rows = []
    for f, (x, y) in feats.items():
        vals = sorted(set(x + y))
        for v in vals:
            rows.append(("g", f, float(v), x.count(v), y.count(v)))
    return spark.createDataFrame(rows, "feature_group string, feature string, value double, a long, b long")


@pytest.mark.parametrize("buckets", [1, None, 4])
def test_mwu_matches_brute_force(spark, buckets):
    rnd = random.Random(7)
    feats = {
        "tied": ([rnd.randint(0, 4) for _ in range(120)], [rnd.randint(0, 6) for _ in range(80)]),
        "binary": ([rnd.randint(0, 1) for _ in range(90)], [rnd.randint(0, 1) for _ in range(110)]),
        "wide": ([rnd.randint(0, 60) for _ in range(100)], [rnd.randint(10, 70) for _ in range(100)]),
    }
    got = {r["feature"]: r for r in SC.mwu(hist_df(spark, feats), buckets=buckets).collect()}
    for f, (x, y) in feats.items():
        u, z, p = brute_mwu(x, y)
        assert got[f]["u_stat"] == pytest.approx(u, abs=1e-9)
        assert got[f]["z"] == pytest.approx(z, rel=1e-9)
        assert got[f]["p_value"] == pytest.approx(p, rel=1e-9)


def test_constant_feature_has_p_one(spark):
    feats = {"const": ([1] * 10, [1] * 12)}
    r = SC.mwu(hist_df(spark, feats)).collect()[0]
    assert r["p_value"] == 1.0 and r["z"] is None


def test_empty_group_has_null_p(spark):
    df = spark.createDataFrame([("g", "f", 0.0, 5, 0), ("g", "f", 1.0, 3, 0)],
                               "feature_group string, feature string, value double, a long, b long")
    assert SC.mwu(df).collect()[0]["p_value"] is None


def brute_bh(ps):
    idx = [i for i, p in enumerate(ps) if p is not None]
    m = len(idx)
    order = sorted(idx, key=lambda i: ps[i])
    q = [None] * len(ps)
    running = 1.0
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        running = min(running, ps[i] * m / rank)
        q[i] = min(1.0, running)
    return q


@pytest.mark.parametrize("buckets", [1, None, 2, 7])
def test_bh_matches_step_up(spark, buckets):
    rnd = random.Random(3)
    ps = [round(rnd.random(), 2) for _ in range(150)] + [1.0, None, 0.0, 0.0]
    df = spark.createDataFrame([("g", f"f{i}", p) for i, p in enumerate(ps)],
                               "feature_group string, feature string, p_value double")
    got = {r["feature"]: r["p_value_corrected"] for r in SC.bh(df, buckets=buckets).collect()}
    want = brute_bh(ps)
    for i, w in enumerate(want):
        g = got[f"f{i}"]
        if w is None:
            assert g is None
        else:
            assert g == pytest.approx(w, abs=1e-12)
            assert g >= ps[i]


def test_bh_within_groups(spark):
    df = spark.createDataFrame([("a", "x", 0.01), ("a", "y", 0.04), ("b", "z", 0.04)],
                               "feature_group string, feature string, p_value double")
    got = {r["feature"]: r["p_value_corrected"] for r in SC.bh(df).collect()}
    assert got == pytest.approx({"x": 0.02, "y": 0.04, "z": 0.04})


def test_t_pvalue_known_values():
    # two-sided Student t: t=2, df=10 -> 0.0733880; t=1, df=1 -> 0.5
    assert stats.t_two_sided_p(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_two_sided_p(1.0, 1.0) == pytest.approx(0.5, abs=1e-12)
    # large df approaches the normal
    assert stats.t_two_sided_p(1.96, 1e6) == pytest.approx(stats.normal_two_sided_p(1.96), rel=1e-4)


def test_ttest_matches_closed_form(spark):
    rnd = random.Random(11)
    rows = [(i, 1 if i % 3 == 0 else 0, float(rnd.randint(18, 80))) for i in range(200)]
    df = spark.createDataFrame(rows, "person_id long, group int, age double")
    r = SC.ttest(df, ["age"]).collect()[0]
    x = [a for _, g, a in rows if g == 1]
    y = [a for _, g, a in rows if g == 0]
    m1, m0 = sum(x) / len(x), sum(y) / len(y)
    v1 = sum((a - m1) ** 2 for a in x) / (len(x) - 1)
    v0 = sum((a - m0) ** 2 for a in y) / (len(y) - 1)
    dof = len(x) + len(y) - 2
    sp2 = ((len(x) - 1) * v1 + (len(y) - 1) * v0) / dof
    t = (m1 - m0) / math.sqrt(sp2 * (1 / len(x) + 1 / len(y)))
    assert r["t_stat"] == pytest.approx(t, rel=1e-9)
    assert r["p_value"] == pytest.approx(stats.t_two_sided_p(abs(t), dof), rel=1e-9)
    assert r["log2fc"] == pytest.approx(math.log2(m1 / (m0 + 1e-12)), rel=1e-12)


def test_sparse_tokens_equal_dense_indicators(spark):
    """Long-form token summary + implied zeros == the dense 0/1 histogram."""
    rows = [(1, 1, "a | b"), (2, 0, "b"), (3, 1, None), (4, 0, "a | c"), (5, 0, "c")]
    df = spark.createDataFrame(rows, "person_id long, group int, drugs string")
    from cohortkit.operators import tokens as TK
    long = TK.to_long(df, "person_id", "drugs", " | ", keep=["group"])
    n1, n0 = SC.group_totals(df)
    sparse = SC.mwu(SC.sparse_histogram(SC.token_summary(long), n1, n0, "drug"))
    dense_rows = [(p, g, *(1 if d and t in d.split(" | ") else 0 for t in "abc")) for p, g, d in rows]
    dense = spark.createDataFrame(dense_rows, "person_id long, group int, a int, b int, c int")
    dh = SC.mwu(SC.dense_histogram(dense, ["a", "b", "c"], "group", "drug"))
    s = {r["feature"]: (r["u_stat"], r["p_value"], r["log2fc"]) for r in sparse.collect()}
    d = {r["feature"]: (r["u_stat"], r["p_value"], r["log2fc"]) for r in dh.collect()}
    assert s.keys() == d.keys()
    for k in s:
        assert s[k] == pytest.approx(d[k])


def test_ignored_features_do_not_count_in_the_corrections(spark):
    import random
    from cohortkit.operators import screen as SC
    rnd = random.Random(6)
    rows = [(i, rnd.randint(0, 1), rnd.choice("MW"), rnd.choice("xyz"), float(rnd.randint(20, 60)),
             " | ".join(sorted(rnd.sample(["a 1", "b", "c", "d 2"], rnd.randint(1, 3))))) for i in range(120)]
    df = spark.createDataFrame(rows, "person_id long, group int, gender string, race string, age double, drugs string")
    read = lambda **k: {(r["feature_group"], r["feature"]): r for r in SC.volcano(
        df, {"gender": "M", "race": "x"}, ["age"], {"drug": ("drugs", " | ")}, **k).collect()}
    every, some = read(), read(ignore=("race", "d 2"))
    assert set(every) - set(some) == {("demo", "race"), ("drug", "d 2")}
    for group in ("demo", "drug"):
        p = sorted((r["p_value"], f) for (g, f), r in some.items() if g == group)
        for f, r in ((f, r) for (g, f), r in some.items() if g == group):
            want = min(q * len(p) / (i + 1) for i, (q, _) in enumerate(p) if q >= r["p_value"])
            assert r["p_value_corrected"] == pytest.approx(min(1.0, want), abs=1e-9)
            assert r["p_value"] == pytest.approx(every[(group, f)]["p_value"], abs=1e-12)
    with pytest.raises(ValueError):
        SC.volcano(df, {"race": "x"}, [], {}, ignore=["race"]).collect()
