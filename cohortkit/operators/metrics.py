"""Evaluation metrics as aggregates over a predictions table (M1-M8, K1).

Predictions are rows (id, label, prediction[, run_id]); every metric is a grouped
aggregate, optionally per run. Rank metrics (C-index, ROC-AUC) are computed from
(label, prediction) histograms with two-level prefix scans -- never a pairwise join,
never a global sort of person rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.operators import prefix

THRESHOLD = 0.5


def regression(df: DataFrame, y: str = "label", p: str = "prediction",
               by: Sequence[str] = ()) -> DataFrame:
    """M1/M5: MSE and RMSE (per ``by`` group)."""
    err = F.col(p).cast("double") - F.col(y).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg(err * err).alias("mse")).withColumn("rmse", F.sqrt("mse"))


def c_index(df: DataFrame, y: str = "label", p: str = "prediction", by: Sequence[str] = (),
            max_levels: int = 64, buckets: int | None = None) -> DataFrame:
    """M2: concordance index without censoring. Pairs with equal truth are excluded;
    equal predictions count 1/2. Null when there are no admissible pairs.

    For each truth level ``lo``: nlo(p) people at y=lo, nhi(p) people at y>lo,
    pre(p) = sum of nlo below p, tot = sum of nlo.
    C = sum nhi (pre + nlo/2) / sum nhi tot. Work: distinct (level, prediction) pairs.
    With up to ``max_levels`` truth levels this level expansion is used; beyond it the
    exact merge tree of ``concordance.py`` takes over (continuous truth).
    """
    by = list(by)
    hist = (df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
              .groupBy(*by, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
              .agg(F.count(F.lit(1)).alias("_n")))
    # levels and their histogram row counts in one small job (bounded by max_levels + 1)
    lvc = [(r[0], r[1]) for r in hist.groupBy("_y").count().orderBy("_y").limit(max_levels + 1).collect()]
    lv = [y for y, _ in lvc]
    if buckets is None and len(lv) <= max_levels:
        # each histogram row is expanded once per level <= its own: an exact upper bound
        expanded = sum(cnt * (i + 1) for i, (_, cnt) in enumerate(lvc))
        if expanded <= prefix.SINGLE_LEVEL_MAX_ROWS:
            buckets = 1
    if len(lv) > max_levels:
        # many truth levels: the exact merge tree (no level list)
        from cohortkit.operators.concordance import c_index_continuous, c_index_groups
        from cohortkit.session import materialise
        if by:
            return c_index_groups(materialise(hist), by)
        v = c_index_continuous(materialise(hist.select("_y", "_p", "_n")))
        return df.sparkSession.createDataFrame([(v,)], "c_index double")
    # each histogram row is the 'lo' side of its own level and a 'hi' side of every lower level
    los = F.filter(F.array(*[F.lit(float(v)) for v in lv]) if lv else F.array().cast("array<double>"),
                   lambda x: x <= F.col("_y"))
    ex = hist.select(*by, "_p", "_y", "_n", F.explode(los).alias("_lo"))
    lvl = (ex.groupBy(*by, "_lo", "_p")
             .agg(F.sum(F.when(F.col("_lo") == F.col("_y"), F.col("_n")).otherwise(0)).alias("nlo"),
                  F.sum(F.when(F.col("_lo") < F.col("_y"), F.col("_n")).otherwise(0)).alias("nhi")))
    lvl = prefix.running(lvl, "_p", ["nlo"], by=[*by, "_lo"], buckets=buckets)
    tot = lvl.groupBy(*by, "_lo").agg(F.sum("nlo").alias("_tot"))
    lvl = lvl.join(tot, [*by, "_lo"])
    nhi = F.col("nhi").cast("double")
    g = lvl.groupBy(*by) if by else lvl.groupBy()
    out = g.agg(F.sum(nhi * (F.col("nlo_before") + F.col("nlo") / 2.0)).alias("_num"),
                F.sum(nhi * F.col("_tot")).alias("_den"))
    return out.select(*by, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).alias("c_index"))


def triple(df: DataFrame, y: str = "label", p: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """M3: mse, rmse, c-index in one row (per group)."""
    r = regression(df, y, p, by)
    c = c_index(df, y, p, by)
    return r.join(c, list(by), "full") if by else _one_row_join(r, c)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    # two single-row aggregates: attach b's scalars as literals (no cross join)
    row = b.first()
    return a.withColumns({k: F.lit(row[k]) for k in b.columns})


def fine_grained(df: DataFrame, labels: str = "labels", preds: str = "predictions") -> DataFrame:
    """M4: metrics over the flattened parts, and over the per-row sums of the parts."""
    flat = df.select(F.explode(F.arrays_zip(F.col(labels).alias("y"), F.col(preds).alias("p"))).alias("z")) \
             .select(F.col("z.y").cast("double").alias("label"), F.col("z.p").cast("double").alias("prediction"))
    add = lambda acc, x: acc + x
    tot = df.select(F.aggregate(F.col(labels).cast("array<double>"), F.lit(0.0), add).alias("label"),
                    F.aggregate(F.col(preds).cast("array<double>"), F.lit(0.0), add).alias("prediction"))
    # both views in one pass, tagged; then the two result rows become one
    both = flat.withColumn("_view", F.lit("individual")).unionByName(tot.withColumn("_view", F.lit("overall")))
    t = triple(both, by=["_view"])
    pick = lambda view, k: F.first(F.when(F.col("_view") == view, F.col(k)), ignorenulls=True)
    return t.agg(*[pick("individual", k).alias(f"individual_{k}") for k in ("mse", "rmse", "c_index")],
                 *[pick("overall", k).alias(k) for k in ("mse", "rmse", "c_index")])


def binary(df: DataFrame, y: str = "label", score: str = "score", threshold: float = THRESHOLD,
           by: Sequence[str] = ()) -> DataFrame:
    """M6: accuracy, precision, recall, F1 at ``score > threshold``; 0/0 -> 0."""
    pred = (F.col(score) > threshold).cast("int")
    yy = F.col(y).cast("int")
    g = df.groupBy(*by) if by else df.groupBy()
    c = g.agg(F.sum(((pred == 1) & (yy == 1)).cast("long")).alias("tp"),
              F.sum(((pred == 1) & (yy == 0)).cast("long")).alias("fp"),
              F.sum(((pred == 0) & (yy == 1)).cast("long")).alias("fn"),
              F.sum(((pred == 0) & (yy == 0)).cast("long")).alias("tn"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return c.select(*by, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))


def roc_auc(df: DataFrame, y: str = "label", score: str = "score", by: Sequence[str] = (),
            buckets: int | None = None) -> DataFrame:
    """M7: exact ROC-AUC in rank form, U1 / (n1 n0), ties count 1/2.

    Histogram (score, positives, negatives) -> two-level prefix of negatives below each
    score. Null when a class is empty."""
    by = list(by)
    h = (df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
           .groupBy(*by, F.col(score).cast("double").alias("_s"))
           .agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"),
                F.sum((F.col(y) != 1).cast("long")).alias("neg")))
    h = prefix.running(h, "_s", ["neg"], by=by, buckets=buckets)
    g = h.groupBy(*by) if by else h.groupBy()
    a = g.agg(F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_u"),
              F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    den = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return a.select(*by, F.when(den > 0, F.col("_u") / den).alias("roc_auc"))


def rounded_accuracy(df: DataFrame, y: str = "label", p: str = "prediction",
                     by: Sequence[str] = ()) -> DataFrame:
    """M8: share of rows whose half-to-even rounded prediction equals the truth."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.avg((F.bround(F.col(p).cast("double"), 0) == F.col(y).cast("double"))
                       .cast("double")).alias("rounded_accuracy"))


def first_part(col: str) -> Column:
    """M5 input: the first column of an array-valued prediction or label."""
    return F.element_at(F.col(col), 1)


def best_runs(runs: DataFrame, loss: str = "loss", run: str = "run_id", n: int = 3) -> DataFrame:
    """K1: the ``n`` runs with the lowest loss (ties by run id) -- a top-k report."""
    return runs.orderBy(F.col(loss).asc(), F.col(run).asc()).limit(n)
