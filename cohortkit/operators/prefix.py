"""Two-level prefix scan: running sums / minima without an unpartitioned window.

A window ``orderBy(x)`` with no partition key (or one partition key holding most
rows) runs in a single task. Instead:

1. cut the ordering column into ``k`` value buckets from approximate quantiles
   (a small driver-side list of boundaries);
2. aggregate each (group, bucket) to one row and scan those few rows: this gives
   every bucket its offset (the total of all earlier buckets);
3. scan inside each (group, bucket) partition and add the offset.

Rows must be unique on ``by + [order_col]`` -- aggregate to a value histogram first,
so a value shared by a third of all rows is still one row and never a hot bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_B = "_pfx_bucket"
_V = "_pfx_value"


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, 2 * n)


# Up to this many histogram rows a plain window (one partition per ``by`` group) is
# used: the row count is measured, so the largest window partition is bounded by it.
SINGLE_LEVEL_MAX_ROWS = 2_000_000


def plan_buckets(df: DataFrame, max_rows: int = SINGLE_LEVEL_MAX_ROWS) -> tuple[DataFrame, int]:
    """Materialise a histogram (it is read more than once) and choose the bucket count
    from its measured size: 1 below ``max_rows``, else ~2 x shuffle partitions."""
    from cohortkit.session import materialise
    df = materialise(df)
    n = df.count()
    return df, (1 if n <= max_rows else max(default_buckets(df), 2 * (n // max_rows + 1)))


def _bucketize(df: DataFrame, order_col: str, buckets: int) -> DataFrame:
    if buckets <= 1:
        # caller guarantees each ``by`` group is small (e.g. a few category levels)
        return df.withColumn(_B, F.lit(0.0))
    df = df.withColumn(_V, F.col(order_col).cast("double"))
    probs = [i / buckets for i in range(1, buckets)]
    qs = df.approxQuantile(_V, probs, 1.0 / (4 * buckets)) if probs else []
    splits = [float("-inf")] + sorted({q for q in qs if q is not None}) + [float("inf")]
    if len(splits) < 3:  # empty or single-valued input: one bucket
        return df.drop(_V).withColumn(_B, F.lit(0.0))
    b = Bucketizer(splits=splits, inputCol=_V, outputCol=_B, handleInvalid="keep")
    return b.transform(df).drop(_V)


def running(df: DataFrame, order_col: str, cols: Sequence[str], by: Sequence[str] = (),
            how: str = "sum", inclusive: bool = False, descending: bool = False,
            buckets: int | None = None, suffix: str = "_before") -> DataFrame:
    """Add ``<col><suffix>``: the running ``sum``/``min`` of ``col`` over rows that come
    earlier in ``order_col`` order (``inclusive`` adds the current row) within ``by``.

    Exclusive running sums start at 0; exclusive running minima start at null.
    """
    if how not in ("sum", "min"):
        raise ValueError("how must be 'sum' or 'min'")
    by = list(by)
    if buckets is None:
        df, buckets = plan_buckets(df)
    k = buckets
    agg = F.sum if how == "sum" else F.min
    rorder = F.col(order_col).desc() if descending else F.col(order_col).asc()
    end = Window.currentRow if inclusive else -1
    if k <= 1:
        # single level: each ``by`` group is one window partition (bounded by the caller
        # or by the measured row count); partitioning on ``by`` alone lets a following
        # groupBy(by) reuse it without another shuffle
        w = Window.partitionBy(*by).orderBy(rorder).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[(F.coalesce(agg(c).over(w), F.lit(0)) if how == "sum" else agg(c).over(w))
                                .alias(c + suffix) for c in cols])
    bdf = _bucketize(df, order_col, k)

    # level 1: one row per (group, bucket) and the scan over buckets
    tot = bdf.groupBy(*by, _B).agg(*[agg(c).alias(f"_t_{c}") for c in cols])
    border = F.col(_B).desc() if descending else F.col(_B).asc()
    wb = Window.partitionBy(*by).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*by, _B, *[agg(f"_t_{c}").over(wb).alias(f"_o_{c}") for c in cols])
    if not by:
        # at most k rows: bounded by the bucket count, safe to broadcast
        offsets = F.broadcast(offsets)

    # level 2: scan inside each (group, bucket)
    wr = Window.partitionBy(*by, _B).orderBy(rorder).rowsBetween(Window.unboundedPreceding, end)
    rows = bdf.select("*", *[agg(c).over(wr).alias(f"_r_{c}") for c in cols])

    out = rows.join(offsets, [*by, _B], "left")
    if how == "sum":
        res = [(F.coalesce(F.col(f"_o_{c}"), F.lit(0)) + F.coalesce(F.col(f"_r_{c}"), F.lit(0)))
               .alias(c + suffix) for c in cols]
    else:
        res = [F.least(F.col(f"_o_{c}"), F.col(f"_r_{c}")).alias(c + suffix) for c in cols]
    keep = [c for c in df.columns]
    return out.select(*keep, *res)
