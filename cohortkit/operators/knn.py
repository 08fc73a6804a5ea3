"""Exact k-nearest-neighbour graph (V2), the first stage of a UMAP-style layout.

No pairwise join is ever formed. Points are cut into value blocks along the axis of
largest variance ``s`` (quantile buckets, so blocks are contiguous ``s`` intervals):

1. inside each block, exact kNN gives every point ``k`` candidates and a radius ``r``
   (distance to its k-th candidate);
2. since ``|s_i - s_j| <= ||x_i - x_j||``, a true neighbour of ``i`` can only sit in a
   block whose interval meets ``[s_i - r_i, s_i + r_i]`` -- a contiguous block range,
   found by bucketing ``s - r`` and ``s + r``; ``i`` is sent as a query to those only,
   with ``r_i``, so that a block ranks only the points within it;
3. every (block, query chunk, data chunk) group holds at most ~``block_rows`` queries
   and ~``block_rows`` points: crowded blocks (many queries, or many points sharing a
   value) are split by hash and the other side is replicated per chunk, so no task
   ever holds an unbounded group. Each group emits only ``k`` rows per query;
4. candidates are merged with ``row_number() <= k`` (ties: distance, then id).

``queries`` limits the points whose neighbours are sought (a search); all points remain data.

The result is exact. Work is ``queries x (blocks reached)``; pruning is strong when the
data has a dominant axis and degrades gracefully toward block-by-block all-pairs. A block's
rows grow with the root of the point count (``block_rows`` at least, ``MOST_ROWS`` at most),
so that the rows copied to blocks grow no faster than the points times that root.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 16_384     # points of a block, and queries of a group, however many points there are
STEP_CELLS = 4_000_000  # distances that a task computes at a time
STEP_PAIRS = 200_000    # candidate pairs whose exact distance it computes at a time
_OUT = "id long, nbr long, dist double"


def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


def _topk(q: np.ndarray, qid: np.ndarray, d: np.ndarray, did: np.ndarray, k: int,
          reach: np.ndarray | None = None) -> pd.DataFrame:
    """k nearest rows of ``d`` for each row of ``q`` (self excluded), exact distances. Rows
    farther than ``reach``, where it is finite, are not wanted and may be left out."""
    ids, nbrs, dists = [], [], []
    if len(q) and len(d):
        dn = (d * d).sum(1)
        step = max(1, STEP_CELLS // len(d))
        for s in range(0, len(q), step):
            qb, ib = q[s:s + step], qid[s:s + step]
            qn = (qb * qb).sum(1)
            d2 = qn[:, None] + dn[None, :] - 2.0 * qb @ d.T
            bound = np.full(len(qb), np.inf) if reach is None else reach[s:s + step] ** 2
            # every point up to the k-th distance (self may be one more), with a margin for
            # rounding: all of a tie must reach the exact ordering by distance and id
            far = ~np.isfinite(bound)
            if far.any():
                m = min(len(d), k + 1)
                bound[far] = np.partition(d2[far], m - 1, axis=1)[:, m - 1]
            near = d2 <= (bound + 1e-9 * (qn + dn.max() + 1.0))[:, None]
            # ties may be many: the pairs looked at together are bounded
            upto = np.cumsum(near.sum(1))
            start = 0
            while start < len(qb):
                before = upto[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(upto, before + STEP_PAIRS, side="right")))
                r, c = np.nonzero(near[start:end])
                r += start
                other = did[c] != ib[r]
                r, c = r[other], c[other]
                exact = np.sqrt(((d[c] - qb[r]) ** 2).sum(1))
                order = np.lexsort((did[c], exact, r))
                r, c, exact = r[order], c[order], exact[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                ids.append(ib[r[best]])
                nbrs.append(did[c[best]])
                dists.append(exact[best])
                start = end
    return pd.DataFrame({"id": np.concatenate(ids or [np.zeros(0)]).astype("int64"),
                         "nbr": np.concatenate(nbrs or [np.zeros(0)]).astype("int64"),
                         "dist": np.concatenate(dists or [np.zeros(0)]).astype("float64")})


def _cross(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        qd, dd = pdf[pdf["_q"] == 1], pdf[pdf["_q"] == 0]
        if len(qd) == 0 or len(dd) == 0:
            return _topk(np.zeros((0, 1)), np.zeros(0, "int64"), np.zeros((0, 1)), np.zeros(0, "int64"), k)
        return _topk(np.stack(qd["v"].to_numpy()), qd["id"].to_numpy(),
                     np.stack(dd["v"].to_numpy()), dd["id"].to_numpy(), k, qd["_r"].to_numpy())
    return run


def _blocked(queries: DataFrame, data: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Top-k of every query (id, v, _t) among the data points (id, v, _t) of block _t, within the
    distance ``_r`` where the queries have one."""
    if "_r" not in queries.columns:
        queries = queries.withColumn("_r", F.lit(float("inf")))
    nq = queries.groupBy("_t").agg(F.count(F.lit(1)).alias("_nq"))
    nd = data.groupBy("_t").agg(F.count(F.lit(1)).alias("_nd"))
    chunks = (nq.join(nd, "_t").select(
        "_t", F.greatest(F.lit(1), F.ceil(F.col("_nq") / block_rows)).cast("int").alias("_qc"),
        F.greatest(F.lit(1), F.ceil(F.col("_nd") / block_rows)).cast("int").alias("_dc")))
    # one row per block: joined back on the block id (Catalyst/AQE pick the strategy)
    qrows = (queries.join(chunks, "_t")
             .select("id", "v", "_r", "_t", F.pmod(F.xxhash64("id"), F.col("_qc")).alias("_cq"),
                     F.explode(F.sequence(F.lit(0), F.col("_dc") - 1)).alias("_cd"), F.lit(1).alias("_q")))
    drows = (data.join(chunks, "_t")
             .select("id", "v", F.lit(0.0).alias("_r"), "_t", F.explode(F.sequence(F.lit(0), F.col("_qc") - 1)).alias("_cq"),
                     F.pmod(F.xxhash64("id"), F.col("_dc")).alias("_cd"), F.lit(0).alias("_q")))
    return qrows.unionByName(drows).groupBy("_t", "_cq", "_cd").applyInPandas(_cross(k), _OUT)


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_graph(df: DataFrame, id_col: str, vec_col: str, k: int = 15, block_rows: int = 2048,
              queries: Column | None = None) -> DataFrame:
    """(id, nbr_id, rank, dist): the ``k`` nearest other points, exact, of every point or of
    those for which ``queries`` holds."""
    from cohortkit.session import materialise
    x = materialise(df.select(F.col(id_col).cast("long").alias("id"),
                              F.col(vec_col).cast("array<double>").alias("v"),
                              (F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))).alias("_ask")))
    n = x.count()
    block_rows = max(block_rows, min(MOST_ROWS, math.isqrt(n * block_rows)) if n > 16 * block_rows else 0)
    var = x.select(Summarizer.variance(array_to_vector("v")).alias("var")).first()["var"].toArray()
    axis = int(np.argmax(var))
    nb = max(1, math.ceil(n / block_rows))
    x = x.withColumn("_s", F.col("v")[axis])
    qs = x.approxQuantile("_s", [i / nb for i in range(1, nb)], 1.0 / (4 * nb)) if nb > 1 else []
    splits = [float("-inf")] + sorted(set(qs)) + [float("inf")]
    if len(splits) < 3:  # one block
        x = materialise(x.withColumn("_t", F.lit(0)))
    else:
        x = materialise(Bucketizer(splits=splits, inputCol="_s", outputCol="_bd").transform(x)
                        .withColumn("_t", F.col("_bd").cast("int")).drop("_bd"))
    nblocks = len(splits) - 1

    # 1. in-block candidates and the radius they give
    local = materialise(_best(_blocked(x.where("_ask").select("id", "v", "_t"), x.select("id", "v", "_t"),
                                       k, block_rows), k))
    rad = local.groupBy("id").agg(F.max("dist").alias("_r"), F.count(F.lit(1)).alias("_c")) \
        .select("id", F.when(F.col("_c") >= k, F.col("_r")).otherwise(F.lit(float("inf"))).alias("_r"))

    # 2. queries to the other blocks within reach (a contiguous block range)
    if nblocks > 1:
        q = (x.where("_ask").join(rad, "id", "left").withColumn("_r", F.coalesce("_r", F.lit(float("inf"))))
             .withColumn("_lo_s", F.col("_s") - F.col("_r")).withColumn("_hi_s", F.col("_s") + F.col("_r")))
        q = Bucketizer(splitsArray=[splits, splits], inputCols=["_lo_s", "_hi_s"],
                       outputCols=["_lo", "_hi"]).transform(q)
        reach = F.filter(F.sequence(F.col("_lo").cast("int"), F.col("_hi").cast("int")),
                         lambda t: t != F.col("_t"))
        far = _blocked(q.select("id", "v", "_r", F.explode(reach).alias("_t")), x.select("id", "v", "_t"), k, block_rows)
        cand = local.select("id", "nbr", "dist").unionByName(far)
    else:
        cand = local.select("id", "nbr", "dist")
    return _best(cand, k).select(F.col("id").alias(id_col), F.col("nbr").alias("nbr_id"),
                                 F.col("rank").cast("int").alias("rank"), "dist")
