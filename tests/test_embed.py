"""Incremental embedding cache and PCA."""
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import embed as EM


def test_cache_delta_then_zero(spark):
    texts = [(i, f"text number {i}") for i in range(10)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    path = os.path.join(tempfile.mkdtemp(prefix="ck-cache-"), "cache")
    enc = EM.HashingEncoder(dim=16)
    _, n0 = EM.embed_with_cache(spark, df.where("doc_id < 6"), "text", "doc_id", path, enc)
    assert n0 == 6
    changed = df.withColumn("text", F.when(F.col("doc_id") == 0, "changed text").otherwise(F.col("text")))
    out, n1 = EM.embed_with_cache(spark, changed, "text", "doc_id", path, enc)
    assert n1 == 5  # 4 never seen + 1 changed
    assert out.where(F.col("vector").isNull()).count() == 0
    _, n2 = EM.embed_with_cache(spark, changed, "text", "doc_id", path, enc)
    assert n2 == 0


def test_hashing_encoder_mean_pools(spark):
    df = spark.createDataFrame([("a a b",), ("",)], "text string")
    v = [r[0] for r in EM.HashingEncoder(dim=8).encode(df, "text").select("vector").collect()]
    assert sum(v[0]) == pytest.approx(1.0) and sum(v[1]) == 0.0


def test_encoders_truncate_to_max_tokens(spark):
    df = spark.createDataFrame([(0, "a b  c\td e"), (1, "a  b"), (2, None), (3, "a b c")], "i int, text string")
    read = lambda enc, d=df: [r["vector"] for r in enc.encode(d, "text").orderBy("i").collect()]
    cut = df.withColumn("text", F.when(F.col("i") == 0, "a b c").otherwise(F.col("text")))
    short = EM.HashingEncoder(dim=16, max_tokens=3)
    assert read(short) == read(EM.HashingEncoder(dim=16), cut) != read(EM.HashingEncoder(dim=16))
    assert short.name == "hashing-16-max3" and EM.HashingEncoder(dim=16).name == "hashing-16"
    batch = EM.BatchEncoder(EM.text_stats_model, dim=3, name="stats", max_tokens=3)
    assert [v[0] for v in read(batch)] == [5, 4, 0, 5] and batch.name == "stats-max3"
    with pytest.raises(ValueError):
        EM.HashingEncoder(max_tokens=0)


def test_missing_column_raises(spark):
    with pytest.raises(ValueError):
        EM.check_columns(spark.createDataFrame([(1,)], "x long"), ["text"])


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                               "id long, v array<double>")
    got = np.array([r["reduced"] for r in EM.pca(df, "v", 3).orderBy("id").collect()])
    xc = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    comps = vt[:3].T
    for j in range(3):
        if comps[np.abs(comps[:, j]).argmax(), j] < 0:
            comps[:, j] *= -1
    assert np.allclose(got, xc @ comps, atol=1e-6)


def test_batch_encoder_runs_model_in_arrow_batches(spark):
    texts = ["hello there", "", "e 1 2 3 e", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = EM.BatchEncoder(EM.text_stats_model, dim=3, name="text-stats", batch_size=2)
    got = {r["doc_id"]: list(r["pred"]) for r in enc.encode(df, "text", "pred").collect()}
    want = {i: [float(len(t or "")), float((t or "").count("e")), float(sum(c.isdigit() for c in (t or "")))]
            for i, t in enumerate(texts)}
    assert got == want


def test_token_pooling_first_and_mean(spark):
    texts = ["ee 12 abc", "", None, "  one\ttwo\n", "a" * 10_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    stats = [[[len(t), t.count("e"), sum(c.isdigit() for c in t)] for t in (x or "").split()] for x in texts]

    def read(**k):
        enc = EM.TokenEncoder(EM.token_stats_model, dim=3, name="s", batch_size=2, **k)
        return enc.name, [r["v"] for r in enc.encode(df, "text", "v").orderBy("i").collect()]

    name, first = read(pooling="first")
    assert name == "s-first" and first == [s[0] if s else [0, 0, 0] for s in stats]
    _, mean = read(pooling="mean")
    for got, s in zip(mean, stats):
        assert got == pytest.approx(np.mean(s, axis=0) if s else [0, 0, 0], rel=1e-6)
    name, short = read(pooling="mean", max_tokens=2)
    assert name == "s-mean-max2" and short[0] == pytest.approx([2.0, 1.0, 1.0])
    with pytest.raises(ValueError):
        EM.TokenEncoder(EM.token_stats_model, 3, "s", pooling="last")


def test_token_vectors_leave_the_worker_by_batch(spark):
    """Many texts in one Arrow batch: vectors are handed on after ``batch_size`` texts."""
    def model():
        def run(texts):
            return [np.full((3, 2), len(texts), dtype=np.float32) if t else np.zeros((0, 2), np.float32) for t in texts]
        return run

    enc = EM.TokenEncoder(model, dim=2, name="m", batch_size=4)
    df = spark.range(10).select("id", F.when(F.col("id") % 5 != 0, "x").alias("t")).coalesce(1)
    got = {r["id"]: r["v"] for r in df.select("id", enc.token_vectors(F.col("t")).alias("v")).collect()}
    sizes = [4] * 8 + [2] * 2
    assert got == {i: [[float(sizes[i])] * 2] * 3 if i % 5 else [] for i in range(10)}


def test_nested_token_vectors_hold_no_python_floats(spark):
    import tracemalloc
    vectors = [np.ones((400, 3), dtype=np.float32)] * 32
    tracemalloc.start()
    made = EM._nested(vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.to_pylist()[31] == [[1.0, 1.0, 1.0]] * 400
    assert peak < 2_000_000  # 38,400 numbers: 0.15 MB flat, several MB as nested lists
