"""The bucketed cache: no exchange on its side, and writers that do not disturb each other."""
import re
import tempfile
import uuid

from pyspark.sql import functions as F

from cohortkit.operators import embed as EM
from cohortkit.operators.cache import BucketedCache
from cohortkit.session import materialise


def cache(spark, buckets=16):
    return BucketedCache(spark, f"cache_{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="ck-bucket-") + "/c", buckets)


def texts(spark, n, *more):
    return spark.createDataFrame([(i, f"text number {i % 40}") for i in range(n)] + [(900 + i, t) for i, t in enumerate(more)],
                                 "doc_id long, text string")


def test_delta_then_nothing(spark):
    c, enc = cache(spark), EM.HashingEncoder(dim=8)
    c.update(texts(spark, 25), "text", enc)
    df = texts(spark, 100, None, "", "new")
    assert c.missing(df, "text", enc.name).count() == 15 + 2
    c.update(df, "text", enc)
    assert c.missing(df, "text", enc.name).count() == 0 and c.missing(df, "text", "other model").count() == 42
    out = c.attach(df, "text", enc.name).collect()
    want = {r["doc_id"]: r["vector"] for r in enc.encode(df.where("text is not null"), "text").collect()}
    assert len(out) == 103 and {r["doc_id"]: r["vector"] for r in out if r["vector"] is not None} == want
    assert [r["vector"] for r in out if r["doc_id"] == 900] == [None]


def test_two_writers_and_a_repeated_write(spark):
    c, enc = cache(spark), EM.HashingEncoder(dim=8)
    new = [materialise(enc.encode(c.missing(texts(spark, n), "text", enc.name), "text", "vector")   # both see an empty cache
                       .select(F.lit(enc.name).alias("model"), "text_key", "vector")) for n in (30, 40)]
    for rows in (*new, new[0]):
        c.append(rows)
    assert spark.table(c.name).count() == 100 and c.rows(enc.name).count() == 40
    out = c.attach(texts(spark, 100), "text", enc.name)
    assert out.count() == 100 and out.where("vector is null").count() == 0


def test_cache_side_has_no_exchange(spark):
    c, enc = cache(spark), EM.HashingEncoder(dim=8)
    for n in (10, 20, 30):
        c.update(texts(spark, n), "text", enc)
    for df in (c.missing(texts(spark, 50), "text", enc.name), c.attach(texts(spark, 50), "text", enc.name)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1, plan
        lines = plan.splitlines()
        scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x)
        depth = lambda x: len(re.match(r"[ :+\-|]*", x)[0])
        above, at = [], depth(lines[scan])
        for x in reversed(lines[:scan]):
            if depth(x) < at:
                above.append(x)
                at = depth(x)
        upto = next(i for i, x in enumerate(above) if "SortMergeJoin" in x)
        assert not any("Exchange" in x for x in above[:upto])
