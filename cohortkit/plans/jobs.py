"""End-to-end jobs: the study's scripts re-expressed as Spark jobs over any input paths.

* ``build_three_drug_cohort`` -- person table + exposure table -> top-3 pivot, inner
  join, exact seeded split, written ``partitionBy('split')``;
* ``split_persons`` -- person table alone -> exact seeded split, written the same way;
* ``screen`` -- cohort + packed half-year drugs -> volcano table (+ significant counts);
* ``baselines`` -- train/test split table -> one metrics row per baseline model;
* ``evaluate_completions`` -- generated answers -> parsed scores, metric row, reject count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import narrative as N
from cohortkit.operators import cohort as CO
from cohortkit.operators import labels as LB
from cohortkit.operators import metrics as M
from cohortkit.operators import models as MD
from cohortkit.operators import screen as SC
from cohortkit.operators import split as SP
from cohortkit.operators import tokens as TK
from cohortkit.sources import io
from cohortkit.session import materialise

# The study's reference levels and exposure order.
STUDY_REFERENCES = {"gender": "Man", "race": "White", "ethnicity": "Others"}


def build_three_drug_cohort(persons: DataFrame, exposures: DataFrame, out_path: str | None = None,
                            sizes: Mapping[str, int] | None = None, seed: int = SP.SEED,
                            n: int = 3, order: Sequence | None = None) -> DataFrame:
    """persons (1 row each) x exposures (person_id, concept_name, drug_exposure_start_date)
    -> persons with ``concept_name_1..n`` / ``drug_exposure_start_date_1..n`` ('' when
    missing) and ``split``. People without any exposure drop out (inner join)."""
    order = list(order) if order is not None else [F.col("drug_exposure_start_date").desc(),
                                                   F.col("concept_name")]
    wide = CO.top_n_wide(exposures, "person_id", order, ["concept_name", "drug_exposure_start_date"], n=n)
    cohort = materialise(persons.join(wide, "person_id", "inner"))
    out = SP.exact_split(cohort, "person_id", sizes, seed=seed)
    if out_path:
        io.write_table(out, out_path)
    return out


def split_persons(persons: DataFrame, out_path: str | None = None, sizes: Mapping[str, int] | None = None,
                  seed: int = SP.SEED, key: str = "person_id") -> DataFrame:
    """Person table -> exact seeded split, written ``partitionBy('split')`` (the
    demographics + comorbidity dataset without drugs)."""
    out = SP.exact_split(materialise(persons), key, sizes, seed=seed)
    if out_path:
        io.write_table(out, out_path)
    return out


def screen(cohort: DataFrame, person_drugs: DataFrame, drug_key: str = "person_id",
           drug_col: str = "standard_concept_name", references: Mapping[str, object] = STUDY_REFERENCES,
           ignore: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Match persons to their packed drug list (J3), label them (L1) and screen every
    demographic, comorbidity and drug feature (A1-A8) but those named in ``ignore``: a
    demographic column, one comorbidity or one drug. Returns (volcano, counts)."""
    matched = CO.match_and_merge(cohort, person_drugs, right_key=drug_key, right_cols=[drug_col])
    lab = LB.with_binary_label(matched, out="group")
    tok = {"drug": (drug_col.lower(), TK.DRUG_SEP), "comorbidity": ("comorbidity", TK.COMORBIDITY_SEP)}
    v = SC.volcano(lab, references, ["age"], tok, ignore=ignore)
    return v, SC.significant_count(v)


def baselines(split_table: DataFrame, categorical: Sequence[str] = ("gender", "race", "ethnicity"),
              numeric: Sequence[str] = ("age",), comorbidity_levels: Sequence[str] | None = None,
              label: str = "audit_c_score", kinds: Sequence[str] = ("rf", "linear", "ridge", "elastic", "svr")
              ) -> DataFrame:
    """Expand comorbidity flags with one level list (from train), fit each baseline on
    train, score test: one (model, mse, rmse, c_index) row per model."""
    train_rows = split_table.where(F.col("split") == "train")
    lv = list(comorbidity_levels) if comorbidity_levels is not None else sorted(
        {t for t in TK.levels(TK.to_long(train_rows, "person_id", "comorbidity", TK.COMORBIDITY_SEP),
                              "token", max_levels=200)})
    keep = [*categorical, *numeric, label, "split"]
    wide = TK.indicators_wide(split_table, "person_id", "comorbidity", TK.COMORBIDITY_SEP, lv,
                              prefix="como_", keep=keep)
    flags = {f"como_{v}": f"como_{v}".replace(" ", "_") for v in lv}
    wide = materialise(wide.withColumnsRenamed(flags))
    train, test = wide.where(F.col("split") == "train"), wide.where(F.col("split") == "test")
    out = None
    for kind in kinds:
        m = MD.fit(kind, train, list(categorical), [*numeric, *flags.values()], label=label)
        p = MD.predict(m, test).select(F.col(label).cast("double").alias("label"), "prediction")
        row = M.triple(p).withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def evaluate_completions(df: DataFrame, completion: str = "completion", truth: str = "audit_c_score",
                         out_path: str | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """T7 + M1-M3 (+ M5 per run with ``by``): parse each answer; metrics over the accepted
    rows; rejects counted instead of aborting. With ``out_path`` the metric rows and the
    per-row predictions are written as JSON lines (S5; predictions as rows, not arrays)."""
    score, ok = N.parse_score(completion)
    parsed = df.select("*", score.alias("predicted_score"), ok.alias("accepted"))
    good = parsed.where("accepted").select(*by, F.col(truth).cast("double").alias("label"),
                                           F.col("predicted_score").cast("double").alias("prediction"))
    metrics = M.triple(good, by=list(by))
    g = parsed.groupBy(*by) if by else parsed.groupBy()
    counts = g.agg(F.sum(F.col("accepted").cast("long")).alias("n_accepted"),
                   F.sum((~F.col("accepted")).cast("long")).alias("n_rejected"))
    if out_path:
        io.write_json(metrics, out_path + "/metrics")
        io.write_json(parsed.select(*[c for c in parsed.columns if c != completion]), out_path + "/predictions")
    return metrics, counts
