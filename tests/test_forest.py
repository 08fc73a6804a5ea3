"""The forest is the one that Spark ML grows, however its rows and nodes are dealt out."""
import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from cohortkit.operators import forest as FO
from cohortkit.operators import models as MD
from cohortkit.session import materialise


def _features(spark, n=400):
    rng = np.random.default_rng(11)
    rows = [("abc"[int(g)], float(a), float(b), float(t), float(min(12, max(0, round(a + 3 * b + g)))))
            for g, a, b, t in zip(rng.integers(0, 3, n), rng.normal(4, 2, n), rng.integers(0, 2, n), rng.integers(0, 300, n))]
    df = materialise(spark.createDataFrame(rows + rows[:50], "g string, a double, b double, t double, label double").coalesce(3))
    return materialise(MD.prepare(df, ["g"], ["a", "b", "t"]).transform(df).select("features", "label"))


@pytest.mark.parametrize(("local_rows", "chunk_rows", "level_cells"),
                         [(1_000_000, 20_000, 1_000_000), (40, 64, 150), (1_000_000, 1000, 1), (1, 1000, 1)])
def test_forest_is_that_of_spark(spark, monkeypatch, local_rows, chunk_rows, level_cells):
    x = _features(spark)
    est = RandomForestRegressor(numTrees=5, featureSubsetStrategy="all", maxDepth=6, maxBins=64, bootstrap=True, seed=3)
    monkeypatch.setattr(FO, "LOCAL_ROWS", local_rows)
    monkeypatch.setattr(FO, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(FO, "LEVEL_CELLS", level_cells)
    want, got = ([r["prediction"] for r in m.transform(x).select("prediction").collect()]
                 for m in (est.fit(x), FO.ForestModel.train(est, x)))
    assert got == want and len(set(got)) > 50


def test_a_forest_of_one_leaf_each(spark):
    x = spark.createDataFrame([(1.0, 2.0)] * 8, "a double, y double")
    m = MD.fit("rf", x, [], ["a"], label="y", num_trees=3)
    assert m.stages[-1].totalNumNodes == 3
    assert [r["prediction"] for r in MD.predict(m, x).collect()] == [2.0] * 8


def test_jobs_do_not_grow_with_the_nodes(spark):
    """A batch of nodes is no pass over the rows: a deep forest takes as many jobs as a flat one."""
    df = spark.createDataFrame([(float(i), float(i * 7 % 13)) for i in range(120)], "a double, y double").coalesce(2)
    jobs, nodes = [], []
    for depth in (1, 12):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "")
        try:
            m = MD.fit("rf", df, [], ["a"], label="y", num_trees=2, max_depth=depth, max_memory_mb=0)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
        nodes.append(m.stages[-1].totalNumNodes)
    assert nodes[0] == 6 and nodes[1] > 40 and jobs[0] == jobs[1] > 0
