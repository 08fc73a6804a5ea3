"""Scans and sinks: explicit-schema CSV, partitioned split tables, JSON results."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import encode as EN
from cohortkit.sources import io


def test_csv_scan_with_schema_and_dotted_names(spark):
    d = tempfile.mkdtemp(prefix="ck-csv-")
    for i in range(2):
        with open(os.path.join(d, f"survey_1_{i}.csv"), "w") as f:
            f.write("person_id,audit.c.score,non-empl.merge\n")
            f.write(f"{i},{i + 3},1\n")
    schema = "person_id long, `audit.c.score` int, `non-empl.merge` int"
    df = io.read_table(spark, os.path.join(d, "survey_1_*.csv"), schema=schema, fmt="csv")
    assert df.columns == ["person_id", "audit_c_score", "non_empl_merge"]
    assert sorted(r[1] for r in df.collect()) == [3, 4]
    with pytest.raises(ValueError):
        io.read_table(spark, d, fmt="csv")
    out = io.to_sink_names(df, {"audit_c_score": "audit.c.score"})
    assert "audit.c.score" in out.columns


def test_split_table_partition_pruning(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ck-split-"), "t")
    df = spark.range(100).select(F.col("id").alias("person_id"),
                                 F.when(F.col("id") < 10, "test").otherwise("train").alias("split"))
    io.write_table(df, d)
    assert {"split=test", "split=train"} <= set(os.listdir(d))
    t = io.load_split(spark, d, "test")
    assert t.count() == 10
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_json_sink_and_enrich(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="ck-json-"), "m")
    io.write_json(spark.createDataFrame([(0.5, 0.7)], "mse double, c_index double"), d)
    rows = [json.loads(l) for p in os.listdir(d) if p.endswith(".json") for l in open(os.path.join(d, p))]
    assert rows == [{"mse": 0.5, "c_index": 0.7}]
    base = spark.createDataFrame([(1,), (2,)], "person_id long")
    extra = spark.createDataFrame([(1, "Mild")], "person_id long, fatigue string")
    got = {r[0]: r[1] for r in io.enrich(base, extra).collect()}
    assert got == {1: "Mild", 2: None}


def test_row_norm_needs_two_columns(spark):
    with pytest.raises(ValueError):
        EN.row_norm(["age"])
    df = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
    r = df.select(*EN.row_norm(["a", "b"], eps=0.0)).first()
    assert (r["a"], r["b"]) == pytest.approx((-1.0, 1.0))


def test_zscore_uses_train_stats(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (10.0, "test")], "age double, split string")
    st = EN.train_stats(df, ["age"]).first()
    z = [r[0] for r in EN.zscore(df, st, ["age"]).select("age_z").collect()]
    s = 2 ** 0.5
    assert z == pytest.approx([-1 / s, 1 / s, 8 / s])


def test_bucketed_tables_join_without_shuffle(spark):
    base = tempfile.mkdtemp(prefix="ck-bucket-")
    persons = spark.range(500).select(F.col("id").alias("person_id"), (F.col("id") % 3).alias("g"))
    drugs = spark.range(2000).select((F.col("id") % 500).alias("person_id"), F.col("id").alias("d"))
    a = io.write_bucketed(persons, "ck_persons_b", "person_id", 8, os.path.join(base, "p"))
    b = io.write_bucketed(drugs, "ck_drugs_b", "person_id", 8, os.path.join(base, "d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = a.join(b, "person_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert j.count() == 2000
        assert "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
