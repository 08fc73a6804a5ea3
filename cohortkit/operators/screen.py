"""Per-feature association screen (A1-A10): fold change, Mann-Whitney U, t-test,
Benjamini-Hochberg within feature groups, the volcano table and per-person effects.

Shape of the computation: person rows carry their label; packed token columns are
exploded next to the label, so summaries are one ``groupBy(feature)`` with map-side
partial aggregation and no person x vocabulary matrix. Zeros of sparse indicators are
implied by the group totals. Rank statistics work on value histograms, never on
sorted person rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import stats
from cohortkit.operators import encode, prefix, tokens

# Fixed values of the screen.
EPS = 1e-12
ALPHA = 0.05


def _sum_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def group_totals(df: DataFrame, group: str = "group") -> tuple[int, int]:
    """(n1, n0): persons in the positive / negative group (one scalar aggregate)."""
    r = df.agg(_sum_if(F.col(group) == 1).alias("n1"), _sum_if(F.col(group) == 0).alias("n0")).first()
    return int(r["n1"] or 0), int(r["n0"] or 0)


# ---------------------------------------------------------------- A1 summaries
def token_summary(long: DataFrame, feature: str = "token", group: str = "group") -> DataFrame:
    """A1 sparse: per token, holders in the positive (a) and negative (b) group.
    ``long`` is distinct (person, token) carrying the person's group."""
    return long.groupBy(F.col(feature).alias("feature")).agg(
        _sum_if(F.col(group) == 1).alias("a"), _sum_if(F.col(group) == 0).alias("b"))


def sparse_histogram(summary: DataFrame, n1: int, n0: int, feature_group: str) -> DataFrame:
    """{0: (n1-a, n0-b), 1: (a, b)} per token -- the implied zeros, two rows per token."""
    rows = F.array(
        F.struct(F.lit(0.0).alias("value"), (F.lit(n1) - F.col("a")).alias("a"),
                 (F.lit(n0) - F.col("b")).alias("b")),
        F.struct(F.lit(1.0).alias("value"), F.col("a").alias("a"), F.col("b").alias("b")))
    return (summary.select(F.lit(feature_group).alias("feature_group"), "feature",
                           F.explode(rows).alias("h"))
            .select("feature_group", "feature", F.col("h.value").alias("value"),
                    F.col("h.a").cast("long").alias("a"), F.col("h.b").cast("long").alias("b")))


def dense_histogram(df: DataFrame, cols: Sequence[str], group: str = "group",
                    feature_group: str = "demo") -> DataFrame:
    """A1 dense: value histogram of several numeric columns in one pass (stack + groupBy)."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                           F.col(c).cast("double").alias("value")) for c in cols]))
    return (df.select(F.col(group).alias("_g"), stacked.alias("s"))
              .select("_g", "s.feature", "s.value")
              .where(F.col("value").isNotNull())
              .groupBy("feature", "value")
              .agg(_sum_if(F.col("_g") == 1).alias("a"), _sum_if(F.col("_g") == 0).alias("b"))
              .select(F.lit(feature_group).alias("feature_group"), "feature", "value", "a", "b"))


# ---------------------------------------------------------------- A2 + A3
def mwu(hist: DataFrame, by: Sequence[str] = ("feature_group", "feature"),
        buckets: int | None = 1) -> DataFrame:
    """A2 + A3 from a value histogram (by..., value, a, b).

    R1 = sum a_v (pre_v + (t_v + 1) / 2), U1 = R1 - n1 (n1 + 1) / 2, U = max(U1, n1 n0 - U1),
    z = (U - n1 n0 / 2 - 0.5) / sqrt(n1 n0 / 12 ((n + 1) - sum(t^3 - t) / (n (n - 1)))),
    p = min(1, erfc(z / sqrt 2)). Constant feature -> p = 1; empty group -> p null.

    ``buckets=1`` scans each feature's histogram in one window partition, which is right
    for categorical features (a handful of values each). Pass ``buckets=None`` for
    high-cardinality values: the two-level prefix scan then splits by value range.
    """
    by = list(by)
    h = hist.withColumn("t", F.col("a") + F.col("b"))
    h = prefix.running(h, "value", ["t"], by=by, buckets=buckets)
    a, t, pre = F.col("a").cast("double"), F.col("t").cast("double"), F.col("t_before").cast("double")
    g = h.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n0"),
        F.sum(a * (pre + (t + 1.0) / 2.0)).alias("r1"),
        F.sum(t * t * t - t).alias("ties"),
        F.sum(F.col("value") * F.col("a")).alias("_sv1"),
        F.sum(F.col("value") * F.col("b")).alias("_sv0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u1 = F.col("r1") - n1 * (n1 + 1.0) / 2.0
    u = F.greatest(u1, n1 * n0 - u1)
    var = n1 * n0 / 12.0 * ((n + 1.0) - F.col("ties") / (n * (n - 1.0)))
    empty = (F.col("n1") == 0) | (F.col("n0") == 0)
    z = F.when(empty | (var <= 0), F.lit(None).cast("double")) \
        .otherwise((u - n1 * n0 / 2.0 - 0.5) / F.sqrt(var))
    mean_pos = F.col("_sv1") / n1
    mean_neg = F.col("_sv0") / n0
    return g.select(
        *by, F.col("n1"), F.col("n0"),
        F.when(empty, None).otherwise(F.log2(mean_pos / (mean_neg + EPS) + EPS)).alias("log2fc"),
        F.when(empty, None).otherwise(u).alias("u_stat"),
        z.alias("z"),
        F.when(empty, F.lit(None).cast("double")).when(var <= 0, F.lit(1.0))
         .otherwise(stats.normal_p(z)).alias("p_value"))


# ---------------------------------------------------------------- A4
def ttest(df: DataFrame, cols: Sequence[str], group: str = "group",
          feature_group: str = "demo") -> DataFrame:
    """A4: equal-variance two-sample t-test and continuous log2 fold change per column.
    One aggregation pass; moments come from Spark's merge-stable aggregates."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"),
                                           F.col(c).cast("double").alias("value")) for c in cols]))
    long = df.select(F.col(group).alias("_g"), stacked.alias("s")).select("_g", "s.feature", "s.value")
    pos, neg = F.col("_g") == 1, F.col("_g") == 0
    v = F.col("value")
    g = long.groupBy("feature").agg(
        F.count(F.when(pos, v)).alias("n1"), F.count(F.when(neg, v)).alias("n0"),
        F.avg(F.when(pos, v)).alias("m1"), F.avg(F.when(neg, v)).alias("m0"),
        F.coalesce(F.var_samp(F.when(pos, v)), F.lit(0.0)).alias("v1"),
        F.coalesce(F.var_samp(F.when(neg, v)), F.lit(0.0)).alias("v0"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    dof = n1 + n0 - 2.0
    sp2 = ((n1 - 1.0) * F.col("v1") + (n0 - 1.0) * F.col("v0")) / dof
    se = F.sqrt(sp2 * (1.0 / n1 + 1.0 / n0))
    ok = (F.col("n1") > 0) & (F.col("n0") > 0) & (dof > 0)
    t = F.when(ok & (se > 0), (F.col("m1") - F.col("m0")) / se)
    return g.select(
        F.lit(feature_group).alias("feature_group"), "feature", "n1", "n0",
        F.when(ok, F.log2(F.col("m1") / (F.col("m0") + EPS))).alias("log2fc"),
        t.alias("t_stat"), F.when(ok, dof).alias("dof"),
        F.when(ok & (se > 0), stats.t_p(F.abs(t), dof))
         .when(ok, F.lit(None).cast("double")).alias("p_value"))


# ---------------------------------------------------------------- A5 + A6
def bh(df: DataFrame, p: str = "p_value", by: Sequence[str] = ("feature_group",),
       out: str = "p_value_corrected", buckets: int | None = None,
       rows_hint: int | None = None) -> DataFrame:
    """A5: Benjamini-Hochberg step-up within ``by`` groups.

    rank = #(p' <= p), q = min(1, min_{p' >= p} p' m / rank(p')). Ties share rank and q.
    Null p stays out of m and gets a null q. Both scans are two-level prefix scans, so
    a group with millions of features is not one task.
    """
    from cohortkit.session import materialise
    df = materialise(df)  # read twice and joined on p: both must see the same doubles
    by = list(by)
    valid = df.where(F.col(p).isNotNull())
    hist = valid.groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_cnt"))
    if buckets is None and rows_hint is not None and rows_hint <= prefix.SINGLE_LEVEL_MAX_ROWS:
        buckets = 1  # the caller measured the input: the p histogram is no larger
    if buckets is None:
        hist, buckets = prefix.plan_buckets(hist)
    m = hist.groupBy(*by).agg(F.sum("_cnt").alias("_m"))
    ranked = prefix.running(hist, "_p", ["_cnt"], by=by, inclusive=True, buckets=buckets,
                            suffix="_rank")
    if by:
        ranked = ranked.join(m, by)
    else:  # one group: m is a scalar
        ranked = ranked.withColumn("_m", F.lit(int(m.first()["_m"] or 0)))
    ranked = ranked.withColumn("_v", F.col("_p") * F.col("_m") / F.col("_cnt_rank"))
    q = prefix.running(ranked.select(*by, "_p", "_v"), "_p", ["_v"], by=by, how="min",
                       inclusive=True, descending=True, buckets=buckets, suffix="_q")
    q = q.select(*by, F.col("_p").alias(p), F.least(F.lit(1.0), F.col("_v_q")).alias(out))
    return df.join(q, [*by, p], "left")


def neg_log10(col: str = "p_value_corrected") -> Column:
    """-log10(q + 1e-12), so it saturates at 12."""
    return -F.log10(F.col(col) + EPS)


# ---------------------------------------------------------------- A7
def feature_stats(cohort: DataFrame, categorical: Mapping[str, object], continuous: Sequence[str],
                  token_cols: Mapping[str, tuple[str, str]], group: str = "group",
                  level_source: DataFrame | None = None, unique_key: bool = True,
                  ignore: Sequence[str] = ()) -> DataFrame:
    """A1-A4 for every feature: (feature_group, feature, log2fc, p_value). The cohort has
    one row per person (``unique_key=False`` where it may not).

    ``categorical``: {column: reference level} -> ordinal codes (the source screens the
    codes), ``continuous``: t-test columns, ``token_cols``: {feature_group: (packed column,
    separator)} -> sparse indicators. Features named in ``ignore`` (columns or single
    tokens) are left out before anything is computed, so that they do not count in the
    corrections either.
    """
    categorical = {c: r for c, r in categorical.items() if c not in ignore}
    continuous = [c for c in continuous if c not in ignore]
    n1, n0 = group_totals(cohort, group)
    coded = encode.codes(cohort, categorical, level_source=level_source) if categorical else cohort
    hists = []
    if categorical:
        hists.append(dense_histogram(coded, list(categorical), group, "demo"))
    for fg, (col, sep) in token_cols.items():
        long = tokens.to_long(cohort, "person_id", col, sep, out="token", keep=[group], unique_key=unique_key)
        if ignore:
            long = long.where(~F.col("token").isin(*ignore))
        hists.append(sparse_histogram(token_summary(long, "token", group), n1, n0, fg))
    parts = []
    if not hists and not continuous:
        raise ValueError("every feature is ignored")
    if hists:
        h = hists[0]
        for x in hists[1:]:
            h = h.unionByName(x)
        parts.append(mwu(h).select("feature_group", "feature", "log2fc", "p_value"))
    if continuous:
        parts.append(ttest(cohort, continuous, group, "demo")
                     .select("feature_group", "feature", "log2fc", "p_value"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def volcano(cohort: DataFrame, categorical: Mapping[str, object], continuous: Sequence[str],
            token_cols: Mapping[str, tuple[str, str]], group: str = "group",
            materialise: bool = True, ignore: Sequence[str] = ()) -> DataFrame:
    """The volcano table: feature_group, feature, log2fc, p_value, p_value_corrected,
    neg_log10_q, without the features named in ``ignore``. The per-feature table is vocabulary-sized; it is checkpointed (shared
    checkpoint folder, lineage cut) before the BH scans read it twice."""
    if materialise:
        # the person-level input is read by several jobs (totals, levels, histograms):
        # write the narrow projection once instead of re-running its joins each time
        from cohortkit.session import materialise as _mat
        cols = ["person_id", group, *categorical, *continuous, *[c for c, _ in token_cols.values()]]
        cohort = _mat(cohort.select(*dict.fromkeys(cols)))
    fs = feature_stats(cohort, categorical, continuous, token_cols, group, ignore=ignore)
    rows = None
    if materialise:
        # one row per feature: BH reads it twice (histogram of p, then the join back)
        fs = _mat(fs)
        rows = fs.count()
    out = bh(fs, rows_hint=rows)
    return out.withColumn("neg_log10_q", neg_log10())


# ---------------------------------------------------------------- A8 + A9
def significant_count(volcano_df: DataFrame, alpha: float = ALPHA,
                      by: Sequence[str] = ("feature_group",)) -> DataFrame:
    """Features with corrected p below alpha, per group."""
    return volcano_df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_features"),
        _sum_if(F.col("p_value_corrected") < alpha).alias("n_significant"))


def thresholds(volcano_df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The plot's two horizontal lines as columns."""
    import math
    return volcano_df.agg(
        F.lit(-math.log10(alpha)).alias("alpha_line"),
        F.min(-F.log10(F.col("p_value_corrected"))).alias("fdr_line"))


# ---------------------------------------------------------------- A10
def accumulate(long: DataFrame, feature_stats_df: DataFrame, key: str = "person_id",
               token: str = "token", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """A10: per person, the sum of positive and of negative log2 fold changes over the
    person's tokens. The stats side is one row per feature; it is broadcast only after
    its row count is checked, otherwise the join shuffles."""
    from cohortkit.session import materialise as _mat
    st = _mat(feature_stats_df.select(F.col("feature").alias(token), "log2fc"))
    n = st.count()
    if n <= max_broadcast_rows:
        st = F.broadcast(st)
    fc = F.col("log2fc")
    return (long.join(st, token)
                .groupBy(key)
                .agg(F.coalesce(F.sum(F.when(fc > 0, fc)), F.lit(0.0)).alias("pos_log2fc"),
                     F.coalesce(F.sum(F.when(fc < 0, fc)), F.lit(0.0)).alias("neg_log2fc")))
