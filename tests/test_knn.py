"""Exact kNN graph against brute force, across blocks and chunked groups."""
import numpy as np
import pytest

from cohortkit.operators import knn


@pytest.mark.parametrize("block_rows", [1000, 40, 7])
def test_knn_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5))
    x[:50, 0] = 0.25  # a third of the points share the projection value
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in knn.knn_graph(df, "id", "v", k=4, block_rows=block_rows).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nbr_id"], r["dist"]))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        mine = sorted(got[i])
        assert [j for _, j, _ in mine] == [j for _, j in order]
        assert [dist for _, _, dist in mine] == pytest.approx([dd for dd, _ in order], abs=1e-9)


def test_knn_of_some_points_searches_all(spark, monkeypatch):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    groups = []
    blocked = knn._blocked
    monkeypatch.setattr(knn, "_blocked", lambda q, d, k, rows: groups.append((q.count(), rows)) or blocked(q, d, k, rows))
    got = {}
    for r in knn.knn_graph(df, "id", "v", k=4, block_rows=10, queries=F.col("id") % 20 == 0).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nbr_id"]))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {
        i: [j for _, j in sorted((d[i, j], j) for j in range(400) if j != i)[:4]] for i in range(0, 400, 20)}
    # 20 queries, and blocks that grow with the root of the points
    assert groups[0] == (20, 63)


def test_knn_query_gives_every_vector_its_neighbours(spark, tmp_path):
    from cohortkit.plans import queries as Q
    x = np.random.default_rng(7).normal(size=(50, 4))
    x[20:40] = x[0]  # more vectors at distance 0 than neighbours asked for
    rows = [(i + 1, [float(v) for v in row], 0) for i, row in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in Q.knn_graph(spark, str(tmp_path)).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["nbr_id"]))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {
        i + 1: [j for _, j in sorted((d[i, j], j + 1) for j in range(50) if j != i)[:15]] for i in range(50)}


def test_block_search_bounds_its_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    d, q = rng.normal(size=(60, 3)), rng.normal(size=(30, 3))
    d[10:40], q[:5] = d[0], d[0]
    reach = np.where(np.arange(30) % 2 == 0, np.inf, 2.0)
    args = q, np.arange(100, 130), d, np.arange(60), 4
    whole, within = knn._topk(*args), knn._topk(*args, reach)
    monkeypatch.setattr(knn, "STEP_PAIRS", 7)
    monkeypatch.setattr(knn, "STEP_CELLS", 200)
    assert knn._topk(*args).equals(whole) and knn._topk(*args, reach).equals(within)
    dist = np.sqrt(((q[:, None, :] - d[None, :, :]) ** 2).sum(-1))
    want = [(100 + i, j) for i in range(30) for _, j in sorted((dist[i, j], j) for j in range(60))[:4]]
    assert list(zip(whole["id"], whole["nbr"])) == want
    got = set(zip(within["id"], within["nbr"]))
    assert got >= {(i, j) for i, j in want if dist[i - 100, j] <= reach[i - 100]} and got <= set(want)
