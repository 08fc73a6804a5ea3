"""Level dictionaries against plain sorting."""
import random

import pytest
from pyspark.sql import functions as F

from cohortkit.operators import dictionary as DI


def table(spark, values):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "k long, `a.x` string, b int")


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_codes_equal_sorted_levels(spark, partitions):
    rnd = random.Random(partitions)
    vals = [(rnd.choice([None, "", " x", "é", "Z", "z", *[f"v{i}" for i in range(50)]]), rnd.choice([None, 3, 20, 100]))
            for _ in range(400)]
    df = table(spark, vals)
    known = DI.build(df, {"a.x": "v7", "b": 20}, partitions)
    got = {r["k"]: (r["ac"], r["bc"]) for r in DI.encode(df, known, {"a.x": "ac", "b": "bc"}).collect()}
    la = sorted({a for a, _ in vals if a is not None} - {"v7"}, key=str.encode)
    lb = sorted({str(b) for _, b in vals if b is not None} - {"20"})
    for i, (a, b) in enumerate(vals):
        want_a = -1 if a is None else 0 if a == "v7" else la.index(a) + 1
        want_b = -1 if b is None else 0 if b == 20 else lb.index(str(b)) + 1
        assert got[i] == (want_a, want_b)
    assert DI.sizes(known, ["a.x", "b", "none"]) == {"a.x": len(la) + 1, "b": 3, "none": 0}


def test_a_million_levels_and_a_hot_one_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(DI, "BROADCAST_BYTES", 0)
    n = 1_000_000
    df = spark.range(n + n // 2).select(F.col("id").alias("k"), F.when(F.col("id") < n, F.format_string("%07d", F.col("id") * 7 % n))
                                       .otherwise("0000003").alias("v"))
    coded = DI.encode(df, DI.build(df, {"v": None}), {"v": "code"})
    wrong = coded.where(F.col("code") != F.col("v").cast("int") + 1).count()
    assert wrong == 0 and coded.count() == n + n // 2


def test_unseen_values_absent_reference_and_empty_source(spark):
    df = spark.createDataFrame([(1, "b"), (2, "q"), (3, None)], "k long, v string")
    src = spark.createDataFrame([("a",), ("b",), ("a",)], "v string")
    code = lambda known: [r["c"] for r in DI.encode(df, known, {"v": "c"}).orderBy("k").collect()]
    assert code(DI.build(src, {"v": "nowhere"})) == [2, -1, -1]
    assert code(DI.build(src.limit(0), {"v": None})) == [-1, -1, -1]


def test_one_hot_long_and_vectors_agree(spark):
    from cohortkit.operators import models as MD
    from pyspark.ml.functions import vector_to_array
    train = spark.createDataFrame([(1, "a", "x", 1.0), (2, "c", None, 2.0), (3, "a", "y", 3.0)], "k long, u string, v string, n double")
    test = spark.createDataFrame([(1, "c", "y", 5.0), (2, "zz", None, 6.0)], train.schema)
    known = DI.build(train, {"u": None, "v": None})
    ones = {(r["k"], r["feature_id"]) for r in DI.one_hot_long(test, "k", known, ["u", "v"]).collect()}
    assert ones == {(1, 1), (1, 3)}
    prep = MD.prepare(train, ["u", "v"], ["n"])
    got = [r[0] for r in prep.transform(test).orderBy("k").select(vector_to_array("features")).collect()]
    assert got == [[0.0, 1.0, 0.0, 1.0, 5.0], [0.0, 0.0, 0.0, 0.0, 6.0]]


def test_ranges_keep_no_single_partition(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("v"))
    known = DI.build(df, {"v": None}, partitions=8)
    codes = [r["code"] for r in known.orderBy("level").collect()]
    assert codes == list(range(1, 1001))
