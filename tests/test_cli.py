"""The command-line jobs run end to end on CSV inputs derived from the test tables."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from cohortkit.__main__ import main
from cohortkit.sources.fixtures import Cohort
from tests.conftest import SF0001


def _json_rows(d):
    return [json.loads(l) for p in sorted(os.listdir(d)) if p.endswith(".json") for l in open(os.path.join(d, p))]


def test_cli_build_screen_embed_evaluate(spark):
    c = Cohort(spark, SF0001)
    d = tempfile.mkdtemp(prefix="ck-cli-")
    c.demo_como.withColumnsRenamed({"q1_score": "q1.score", "q2_score": "q2.score", "q3_score": "q3.score",
                                    "audit_c_score": "audit.c.score"}) \
        .write.option("header", True).csv(f"{d}/persons")
    c.exposures.select("person_id", "concept_name", "drug_exposure_start_date") \
        .write.option("header", True).csv(f"{d}/exposures")
    c.packed_drugs.select(F.col("person_id").alias("PERSON_ID"),
                          F.col("standard_concept_name").alias("STANDARD_CONCEPT_NAME")) \
        .write.option("header", True).csv(f"{d}/drugs")
    main(["build-cohort", "--persons", f"{d}/persons", "--exposures", f"{d}/exposures", "--out", f"{d}/cohort",
          "--validation", "5", "--test", "10"])
    assert spark.read.parquet(f"{d}/cohort").where("split = 'test'").count() == 10
    main(["split", "--persons", f"{d}/persons", "--out", f"{d}/split", "--validation", "7", "--test", "3"])
    sp = spark.read.parquet(f"{d}/split")
    assert sp.where("split = 'validation'").count() == 7 and sp.count() == c.demo_como.count()
    main(["screen", "--cohort", f"{d}/cohort", "--drugs", f"{d}/drugs", "--out", f"{d}/screen"])
    assert spark.read.parquet(f"{d}/screen/volcano").count() > 0
    c.texts.write.parquet(f"{d}/texts")
    main(["embed", "--input", f"{d}/texts", "--text-col", "text", "--key-col", "doc_id",
          "--cache", f"{d}/cache", "--out", f"{d}/emb", "--dim", "16", "--k", "4"])
    assert len(spark.read.parquet(f"{d}/emb").columns) == 5
    c.completions.join(c.scored.select("person_id", "audit_c_score"), "person_id").write.parquet(f"{d}/comp")
    main(["evaluate", "--input", f"{d}/comp", "--out", f"{d}/eval"])
    counts = _json_rows(f"{d}/eval/counts")[0]
    assert counts["n_rejected"] > 0 and counts["n_accepted"] > 0
