"""End-to-end jobs on the sf0.001 tables (CSV in, partitioned Parquet out)."""
import os
import tempfile

from pyspark.sql import functions as F

from cohortkit.plans import jobs
from cohortkit.sources import io
from cohortkit.sources.fixtures import Cohort
from tests.conftest import SF0001


def test_build_screen_and_baselines(spark):
    c = Cohort(spark, SF0001)
    d = tempfile.mkdtemp(prefix="ck-jobs-")
    # the study's inputs arrive as CSV: write the fixture views that way, read with schemas
    c.demo_como.write.option("header", True).csv(os.path.join(d, "demo_como"))
    c.exposures.select("person_id", "concept_name", "drug_exposure_start_date") \
        .write.option("header", True).csv(os.path.join(d, "top3"))
    persons = io.read_table(spark, os.path.join(d, "demo_como"), c.demo_como.schema, fmt="csv")
    expo = io.read_table(spark, os.path.join(d, "top3"),
                         "person_id long, concept_name string, drug_exposure_start_date date", fmt="csv")
    out = os.path.join(d, "cohort")
    built = jobs.build_three_drug_cohort(persons, expo, out, sizes={"validation": 5, "test": 10})
    counts = {r["split"]: r["count"] for r in built.groupBy("split").count().collect()}
    assert counts["validation"] == 5 and counts["test"] == 10
    assert io.load_split(spark, out, "test").count() == 10
    v, n = jobs.screen(spark.read.parquet(out), c.packed_drugs, references={"gender": "Man"})
    assert {r["feature_group"] for r in n.collect()} == {"demo", "drug", "comorbidity"}
    b = jobs.baselines(spark.read.parquet(out), kinds=("linear", "ridge"))
    assert b.count() == 2 and b.where(F.col("mse").isNull()).count() == 0
