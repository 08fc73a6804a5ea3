"""Exact C-index for a continuous truth (M2 without a level list), over all rows or by group.

Pairs (i, j) with y_i < y_j count 1 when p_i < p_j and 1/2 when p_i = p_j. On the
(y, p, n) histogram:

* admissible pairs  = ((sum n)^2 - sum_y n_y^2) / 2
* tied predictions  = sum_p (m_p^2 - sum_y n_{p,y}^2) / 2
* concordant pairs  = sum_j n_j * #{i : y_i < y_j, p_i < p_j}   (2-D dominance count)

The dominance count is a merge tree. Rows are put in the order (y, p descending), in which
rows of one y never count for each other, and dealt out by range into blocks of about
``block_rows`` rows: the leaves. Pairs inside a block are counted there. Above, ``FAN``
neighbouring nodes are merged at a time: a pair of different blocks meets in the one level
where its blocks become children of one node, and counts there if the earlier child's p is
the smaller. A level is one range partitioning by (node, p) and a running sum by child; what
lies in the ranges before is a table of offsets (node, range, child), joined by range. A
level has no more than FAN numbers a range, there are log_FAN(rows / block_rows) levels, and
nothing of the data's size reaches the driver.

Histogram rows are distinct, so neither a value shared by very many rows nor a large group
makes a large block. Counts are exact integers (decimals of 38 digits between tasks).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import materialise

FAN = 64
_CONC = "_g long, conc decimal(38,0)"


def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


def _dot(n: np.ndarray, w: np.ndarray) -> int:
    """Sum of n * w without leaving 64 bits on the way."""
    low = (1 << 31) - 1
    return (int(np.dot(n, w >> 31)) << 31) + int(np.dot(n, w & low))


def _inside(p: np.ndarray, n: np.ndarray) -> int:
    """Concordant weight of rows given in rank order. On each level of a binary tree over
    the ranks the rows of a node lie by p, and a right row meets the left rows before it."""
    m = len(p)
    rank = np.arange(m)
    order = np.lexsort((-rank, p))             # of equal p the higher rank first: they do not count
    total = 0
    for bit in range(max(m - 1, 0).bit_length()):
        at = order[np.argsort(order >> (bit + 1), kind="stable")]
        right = (at >> bit) & 1 == 1
        left = np.where(right, 0, n[at])
        below = left.cumsum() - left
        node = at >> (bit + 1)
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        below = below - np.repeat(below[starts], np.diff(np.append(starts, m)))
        total += _dot(n[at][right], below[right])
    return total


def _inside_block(pdf: pd.DataFrame) -> pd.DataFrame:
    from decimal import Decimal
    pdf = pdf.assign(_m=-pdf["_p"]).sort_values(["_g", "_y", "_m"], kind="mergesort")
    out = [(g, Decimal(_inside(x["_p"].to_numpy(), x["_n"].to_numpy(dtype="int64")))) for g, x in pdf.groupby("_g")]
    return pd.DataFrame(out, columns=["_g", "conc"])


def _merged(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """One range of a level: each row meets the rows of earlier children with smaller p, in
    this range by running sums, in the ranges before by the offsets."""
    from decimal import Decimal
    offsets = {key: dict(zip(x["child"], x["before"])) for key, x in before.groupby(["g", "node"])}
    out = []
    rows = rows.assign(_c=-rows["_child"]).sort_values(["_g", "_node", "_p", "_c"], kind="mergesort")
    for (g, node), x in rows.groupby(["_g", "_node"], sort=False):
        child, n = x["_child"].to_numpy(), x["_n"].to_numpy(dtype="int64")
        earlier, total = offsets.get((g, node), {}), 0
        for c in sorted(set(earlier) | set(child.tolist())):
            later = child > c
            if later.any():
                w = np.where(child == c, n, 0).cumsum() + int(earlier.get(c, 0))
                total += _dot(n[later], w[later])
        out.append((g, Decimal(total)))
    return pd.DataFrame(out, columns=["_g", "conc"])


def _level(rows: DataFrame, width: int, ranges: int) -> DataFrame:
    """Concordant weight between the children (``width`` blocks each) of each node."""
    child = F.floor(F.col("_block") / width)
    x = rows.select("_g", "_p", "_n", F.floor(child / FAN).alias("_node"), (child % FAN).alias("_child"), "_y")
    # written once, so that rows and offsets agree on the ranges
    x = materialise(x.repartitionByRange(ranges, "_g", "_node", "_p", F.desc("_child"), "_y")
                    .withColumn("_range", F.spark_partition_id()))
    cells = x.groupBy(F.col("_g").alias("g"), F.col("_node").alias("node"), F.col("_range").alias("at"),
                      F.col("_child").alias("child")).agg(F.sum("_n").alias("w"))
    spans = cells.select("g", "node", "at").distinct()
    grid = spans.join(cells.select("g", "node", "child").distinct(), ["g", "node"])
    before = Window.partitionBy("g", "node", "child").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (grid.join(cells, ["g", "node", "at", "child"], "left")
               .withColumn("before", F.coalesce(F.sum("w").over(before), F.lit(0))).drop("w"))
    # the offsets of a range are those of the nodes in it: few numbers beside its rows
    return x.groupBy("_range").cogroup(offsets.groupBy("at")).applyInPandas(_merged, _CONC)


def concordant(hist: DataFrame, block_rows: int = 200_000) -> DataFrame:
    """(_g, conc) of a materialised histogram of distinct (_g, _y, _p) with weights _n."""
    blocks = max(1, math.ceil(hist.count() / block_rows))
    placed = (hist.repartitionByRange(blocks, "_g", "_y", F.desc("_p")) if blocks > 1 else hist.coalesce(1))
    placed = materialise(placed.withColumn("_block", F.spark_partition_id()))
    out = placed.groupBy("_block").applyInPandas(lambda pdf: _inside_block(pdf), _CONC)
    # only groups over several blocks have pairs between blocks
    spread = (placed.groupBy("_g").agg(F.min("_block").alias("_lo"), F.max("_block").alias("_hi"))
              .where(F.col("_lo") < F.col("_hi")).select("_g"))
    wide = placed.join(spread, "_g", "left_semi")
    width = 1
    while width < blocks:
        out = out.unionByName(_level(wide, width, blocks))
        width *= FAN
    return out.groupBy("_g").agg(F.sum("conc").alias("conc"))


def c_index_groups(hist: DataFrame, by: list[str], block_rows: int = 200_000) -> DataFrame:
    """``by`` columns and c_index of every group of a materialised (by, _y, _p, _n) histogram.
    A null key is a group of its own; a group without admissible pairs gets null."""
    h = hist.withColumn("_g", F.lit(0).cast("long"))
    if by:
        names = {c: f"_by{i}" for i, c in enumerate(by)}
        groups = materialise(hist.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
                             .withColumn("_g", F.monotonically_increasing_id()))
        same = F.lit(True)
        for c, n in names.items():
            same = same & F.col(c).eqNullSafe(F.col(n))
        h = hist.join(groups, same)
    h = materialise(h.select("_g", "_y", "_p", "_n"))

    def square(col):
        whole = F.col(col).cast("decimal(19,0)")
        return F.sum(whole * whole)

    by_y = h.groupBy("_g", "_y").agg(F.sum("_n").alias("m"))
    by_p = h.groupBy("_g", "_p").agg(F.sum("_n").alias("m"), square("_n").alias("s"))
    total = by_y.groupBy("_g").agg(square("m").alias("yy"), F.sum("m").alias("n"))
    ties = by_p.groupBy("_g").agg((square("m") - F.sum("s")).alias("ties"))
    whole = F.col("n").cast("decimal(19,0)")
    parts = total.join(ties, "_g").join(concordant(h, block_rows), "_g", "left")
    # twice the pairs above and below, so that both are whole numbers until the division
    value = F.try_divide(2 * F.coalesce(F.col("conc"), F.lit(0)).cast("double") + F.col("ties").cast("double") / 2,
                         (whole * whole - F.col("yy")).cast("double"))
    scored = parts.select("_g", value.alias("c_index"))
    if not by:
        return scored.select("c_index")
    return scored.join(groups, "_g").select(*[F.col(n).alias(c) for c, n in names.items()], "c_index")


def c_index_continuous(hist: DataFrame, block_rows: int = 200_000) -> float | None:
    """Exact C-index from a materialised (_y, _p, _n) histogram (no grouping columns)."""
    row = c_index_groups(hist, [], block_rows).first()
    return row["c_index"] if row else None
