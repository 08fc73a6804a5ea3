"""The streaming cache embeds each distinct text once, across micro-batches."""
import os
import tempfile

from cohortkit.operators import embed as EM
from cohortkit.streaming import cache_stream


def test_stream_appends_only_new_texts(spark):
    base = tempfile.mkdtemp(prefix="ck-stream-")
    src, cache, ck = (os.path.join(base, p) for p in ("src", "cache", "ck"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a b")], schema).write.parquet(os.path.join(src, "b1"))
    st = spark.createDataFrame([], schema).schema
    q = cache_stream.start(spark, os.path.join(src, "*"), st, "text", cache, checkpoint_location=ck)
    q.awaitTermination(120)
    enc = EM.HashingEncoder()
    assert EM.read_cache(spark, cache, enc.name).count() == 2
    spark.createDataFrame([(4, "c d"), (5, "e f")], schema).write.parquet(os.path.join(src, "b2"))
    q = cache_stream.start(spark, os.path.join(src, "*"), st, "text", cache, checkpoint_location=ck)
    q.awaitTermination(120)
    assert EM.read_cache(spark, cache, enc.name).count() == 3
