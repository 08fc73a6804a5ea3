"""Command-line jobs (``spark-submit -m cohortkit ...`` or ``python -m cohortkit ...``).

    build-cohort  --persons P.csv --exposures E.csv --out DIR [--validation 2000 --test 5000]
    split         --persons P.csv --out DIR [--validation 2000 --test 5000]
    screen        --cohort DIR --drugs D.csv --out DIR
    baselines     --cohort DIR --out DIR [--models rf,linear,ridge,elastic,svr]
    embed         --input DIR --text-col C --key-col K --cache DIR --out DIR [--dim 64 --k 16 --placeholder no_drug]
    evaluate      --input DIR --completion-col C --truth-col T --out DIR [--run-col R]

CSV inputs are read with explicit schemas; dotted source names (``audit.c.score``) are
normalised to underscores. Outputs are Parquet (tables) or JSON (metric rows).
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from cohortkit.session import get_spark

# The source file layouts.
PERSON_SCHEMA = ("person_id long, gender string, race string, ethnicity string, age double, "
                 "comorbidity string, `q1.score` int, `q2.score` int, `q3.score` int, `audit.c.score` int")
EXPOSURE_SCHEMA = "person_id long, concept_name string, drug_exposure_start_date date"
DRUG_SCHEMA = "PERSON_ID long, STANDARD_CONCEPT_NAME string"


def _args(argv=None):
    p = argparse.ArgumentParser(prog="cohortkit")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build-cohort")
    b.add_argument("--persons", required=True)
    b.add_argument("--exposures", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--validation", type=int, default=2000)
    b.add_argument("--test", type=int, default=5000)
    sp = sub.add_parser("split")
    sp.add_argument("--persons", required=True)
    sp.add_argument("--out", required=True)
    sp.add_argument("--validation", type=int, default=2000)
    sp.add_argument("--test", type=int, default=5000)
    s = sub.add_parser("screen")
    s.add_argument("--cohort", required=True)
    s.add_argument("--drugs", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--ignore", action="append", default=[], help="feature to leave out (a column, comorbidity or drug)")
    m = sub.add_parser("baselines")
    m.add_argument("--cohort", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--models", default="rf,linear,ridge,elastic,svr")
    e = sub.add_parser("embed")
    e.add_argument("--input", required=True)
    e.add_argument("--text-col", required=True)
    e.add_argument("--key-col", required=True)
    e.add_argument("--cache", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--dim", type=int, default=64)
    e.add_argument("--k", type=int, default=16)
    e.add_argument("--placeholder", default="no_drug", help="text used for a missing value")
    v = sub.add_parser("evaluate")
    v.add_argument("--input", required=True)
    v.add_argument("--completion-col", default="completion")
    v.add_argument("--truth-col", default="audit_c_score")
    v.add_argument("--run-col", default=None, help="metrics per run / checkpoint")
    v.add_argument("--out", required=True)
    return p.parse_args(argv)


def main(argv=None) -> None:
    a = _args(argv)
    spark = get_spark(app=f"cohortkit-{a.cmd}")
    from cohortkit.plans import jobs
    from cohortkit.sources import io
    if a.cmd == "build-cohort":
        persons = io.read_table(spark, a.persons, PERSON_SCHEMA, fmt="csv")
        expo = io.read_table(spark, a.exposures, EXPOSURE_SCHEMA, fmt="csv")
        jobs.build_three_drug_cohort(persons, expo, a.out, {"validation": a.validation, "test": a.test})
    elif a.cmd == "split":
        persons = io.read_table(spark, a.persons, PERSON_SCHEMA, fmt="csv")
        jobs.split_persons(persons, a.out, {"validation": a.validation, "test": a.test})
    elif a.cmd == "screen":
        cohort = spark.read.parquet(a.cohort)
        drugs = io.read_table(spark, a.drugs, DRUG_SCHEMA, fmt="csv")
        volcano, counts = jobs.screen(cohort, drugs, drug_key="PERSON_ID", drug_col="STANDARD_CONCEPT_NAME",
                                      ignore=a.ignore)
        io.write_table(volcano, a.out + "/volcano", partition_by=None)
        io.write_json(counts, a.out + "/significant")
    elif a.cmd == "baselines":
        out = jobs.baselines(spark.read.parquet(a.cohort), kinds=a.models.split(","))
        io.write_json(out, a.out)
    elif a.cmd == "embed":
        from cohortkit.operators import embed as EM
        from cohortkit.functions.narrative import text_or_placeholder
        df = spark.read.parquet(a.input)
        df = df.withColumn(a.text_col, text_or_placeholder(a.text_col, a.placeholder))
        vec, n_new = EM.embed_with_cache(spark, df, a.text_col, a.key_col, a.cache, EM.HashingEncoder(a.dim))
        red = EM.pca(vec.where(F.col("vector").isNotNull()), "vector", a.k)
        io.write_table(EM.to_columns(red, "reduced", a.k, keep=[a.key_col]), a.out, partition_by=None)
        print(f"embedded {n_new} new texts")
    elif a.cmd == "evaluate":
        by = [a.run_col] if a.run_col else []
        _, counts = jobs.evaluate_completions(spark.read.parquet(a.input), a.completion_col, a.truth_col,
                                              out_path=a.out, by=by)
        io.write_json(counts, a.out + "/counts")


if __name__ == "__main__":
    main()
