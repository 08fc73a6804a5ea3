"""Exact-size seeded split (P5) and split selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The study's seed and hold-out sizes.
SEED = 6179
DEFAULT_SIZES = {"validation": 2000, "test": 5000}


def split_hash(key: str, seed: int = SEED) -> Column:
    """md5(seed || ':' || key) -- the same string hash in Spark and in SQL engines."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


# Above this many hold-out rows the top-k would funnel too much into one task.
MAX_TOPK = 200_000


def exact_split(df: DataFrame, key: str = "person_id", sizes: Mapping[str, int] | None = None,
                rest: str = "train", seed: int = SEED, out: str = "split",
                max_topk: int = MAX_TOPK) -> DataFrame:
    """P5: exactly ``sizes[s]`` keys per hold-out split, the rest ``rest``. All rows of a
    repeated key go to one split, so a person is never in two.

    Rows are ranked by the seeded hash (key breaks ties). Only the first
    ``sum(sizes)`` keys are needed: ``orderBy().limit()`` runs as a per-partition top-k
    merged on one task (``TakeOrderedAndProject``), so no global sort of the table.
    That hold-out set is bounded by the requested sizes and is broadcast back; the big
    side is never shuffled. Hold-outs are taken in dict order (validation first, then
    test from the remainder), as the source does with its two calls.
    """
    sizes = dict(DEFAULT_SIZES if sizes is None else sizes)
    k = sum(sizes.values())
    h = split_hash(key, seed)
    if k > max_topk:
        return _ranked_split(df, key, sizes, rest, h, out)
    picked = (df.select(key, h.alias("_h")).distinct().orderBy("_h", key).limit(k)
                .withColumn("_r", F.row_number().over(Window.orderBy("_h", key))))
    label = None
    hi = 0
    for name, size in sizes.items():
        lo, hi = hi, hi + size
        cond = (F.col("_r") > lo) & (F.col("_r") <= hi)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    picked = picked.select(key, label.alias("_split"))
    return (df.join(F.broadcast(picked), key, "left")
              .withColumn(out, F.coalesce(F.col("_split"), F.lit(rest))).drop("_split"))


def _label(rank: Column, sizes: Mapping[str, int], rest: str) -> Column:
    label, hi = None, 0
    for name, size in sizes.items():
        lo, hi = hi, hi + size
        cond = (rank > lo) & (rank <= hi)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    return label.otherwise(F.lit(rest)) if label is not None else F.lit(rest)


def _ranked_split(df: DataFrame, key: str, sizes: Mapping[str, int], rest: str, h: Column,
                  out: str) -> DataFrame:
    """Large hold-outs: every row's exact rank in (hash, key) order without a global
    sort -- a two-level prefix count over the leading 60 hash bits (equal leading bits
    are ranked by the full hash and the key inside their tiny group)."""
    from cohortkit.operators import prefix
    from cohortkit.session import materialise
    keyed = materialise(df.select(key, h.alias("_h")).distinct()
                        .withColumn("_h60", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")))
    hist = keyed.groupBy("_h60").agg(F.count(F.lit(1)).alias("_c"))
    hist = prefix.running(hist, "_h60", ["_c"], buckets=None)
    w = Window.partitionBy("_h60").orderBy("_h", key)
    ranked = (keyed.join(hist.select("_h60", "_c_before"), "_h60")
                   .withColumn("_r", F.col("_c_before") + F.row_number().over(w)))
    lab = ranked.select(key, _label(F.col("_r"), sizes, rest).alias("_split"))
    return df.join(lab, key, "left").withColumn(out, F.coalesce(F.col("_split"), F.lit(rest))).drop("_split")


def split_counts(df: DataFrame, col: str = "split") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))
