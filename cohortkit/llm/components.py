"""Connected components by alternating large-star and small-star steps.

Every step is an aggregate and a join on the links, which stay on the executors; a node
with very many links is pre-aggregated (minimum) and its join partition is split by
adaptive execution. Each round is written to the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import staged

MAX_ROUNDS = 60


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Links (u, v), v < u. ``both``: large star, else small star."""
    if both:
        links = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = links.join(least, F.col("u") == F.col("c"))
    if both:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of ``links`` (a, b)."""
    now = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    seen = None
    for _ in range(MAX_ROUNDS):
        now = staged(_stars(_stars(now, True), False), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
