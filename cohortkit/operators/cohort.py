"""Cohort assembly: joins, sequence numbers, top-n pivot, roll-ups, dedupe (J1-J7 W1 W2
R1-R3 U1-U3 D1 D2 G5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.operators.tokens import DRUG_SEP

# The ten person columns kept by the drug match.
MATCH_KEEP = ("person_id", "gender", "race", "ethnicity", "age", "comorbidity",
              "q1_score", "q2_score", "q3_score", "audit_c_score")


# ---------------------------------------------------------------- joins
def left_exposures(persons: DataFrame, exposures: DataFrame, key: str = "person_id") -> DataFrame:
    """Every person, with their exposure rows (nulls when none)."""
    return persons.join(exposures, key, "left")


def semi_match(persons: DataFrame, other: DataFrame, key: str = "person_id",
               other_key: str | None = None) -> DataFrame:
    """Persons that appear in ``other`` (``isin`` -> left-semi; no fan-out)."""
    ok = other_key or key
    o = other.select(F.col(ok).alias(key)) if ok != key else other.select(key)
    return persons.join(o, key, "left_semi")


def match_and_merge(persons: DataFrame, right: DataFrame, key: str = "person_id",
                    right_key: str = "person_id", right_cols: Sequence[str] = ("standard_concept_name",),
                    keep: Sequence[str] = MATCH_KEEP) -> DataFrame:
    """The source's semi-join + projection + left merge on differently named keys.
    Net effect is one inner join; a person repeated on the right fans out."""
    r = right.select(F.col(right_key).alias(key), *[F.col(c).alias(c.lower()) for c in right_cols])
    return persons.select(*keep).join(r, key, "inner")


def anti(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is absent from ``right`` (left-anti)."""
    keys = [on] if isinstance(on, str) else list(on)
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def align(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Attach ``right`` rows to every ``left`` key; a missing key is an error
    (the check is one count on the anti-join, run on executors)."""
    missing = left.select(on).join(right.select(on), on, "left_anti").limit(1).count()
    if missing:
        raise KeyError(f"keys of the left side are missing on the right ({on})")
    return left.join(right, on, "inner")


def lookup(df: DataFrame, table: DataFrame, on: str, max_broadcast_rows: int | None = None) -> DataFrame:
    """Key -> value lookup per row. Broadcast only when the table's row count is
    checked to be under ``max_broadcast_rows``; otherwise a shuffle join."""
    if max_broadcast_rows is not None and table.count() <= max_broadcast_rows:
        table = F.broadcast(table)
    return df.join(table, on, "left")


# ---------------------------------------------------------------- sequence and pivot
def sequence(df: DataFrame, by: str, order: Sequence[Column], out: str = "n",
             skew_safe: bool = True, partitions: int | None = None) -> DataFrame:
    """1-based sequence number per ``by`` in a total order (break every tie).

    ``skew_safe`` (default): rows are range-partitioned on (by, order...), so one key
    holding a third of all rows is spread over several sorted partitions instead of
    one window task. Each row gets a consecutive id in its sorted partition; a small
    table with one row per (partition, key) gives each key's offset from the earlier
    partitions (a window over at most ``partitions`` rows per key). The ranged data is
    written once so partition ids and ids are stable."""
    if not skew_safe:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    from cohortkit.session import materialise
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialise(df.repartitionByRange(n, F.col(by), *order)
                         .sortWithinPartitions(F.col(by), *order)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mono", F.monotonically_increasing_id()))
    wb = Window.partitionBy(by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (ranged.groupBy("_pid", by).agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
              .withColumn("_off", F.coalesce(F.sum("_cnt").over(wb), F.lit(0))))
    return (ranged.join(blocks, ["_pid", by])
                  .withColumn(out, (F.col("_mono") - F.col("_first") + 1 + F.col("_off")).cast("int"))
                  .drop("_pid", "_mono", "_first", "_cnt", "_off"))


def top_n(df: DataFrame, by: str, order: Sequence[Column], n: int = 3, out: str = "n") -> DataFrame:
    """First ``n`` rows per ``by``. ``row_number() <= n`` lets Spark insert a partial
    window-group limit before the shuffle, so a person with millions of rows sends at
    most ``n`` rows per map task."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def top_n_wide(df: DataFrame, by: str, order: Sequence[Column], values: Sequence[str],
               n: int = 3, fill: str = "", seq: str = "n") -> DataFrame:
    """R1 + R2: long -> wide for the first ``n`` rows per key, ``value_1..value_n``
    columns cast to string, missing slots ``fill``. Fixed pivot values (no extra job to
    discover them) and ``max(when(...))`` in the same aggregate as the group-by, so it is
    one shuffle shared with the window. Keys whose values are all null drop out."""
    any_value = F.lit(False)
    for v in values:
        any_value = any_value | F.col(v).isNotNull()
    ranked = top_n(df.where(any_value), by, order, n, seq)
    aggs = []
    for v in values:
        for i in range(1, n + 1):
            aggs.append(F.coalesce(F.max(F.when(F.col(seq) == i, F.col(v).cast("string"))),
                                   F.lit(fill)).alias(f"{v}_{i}"))
    return ranked.groupBy(by).agg(*aggs)


def recent_tokens(exposures: DataFrame, by: str = "person_id", name: str = "concept_name",
                  date: str = "drug_exposure_start_date", months: int = 6,
                  index_date: DataFrame | None = None, sep: str = DRUG_SEP,
                  out: str = "standard_concept_name") -> DataFrame:
    """One packed string of the distinct names used within ``months`` before each
    person's index date (default: the person's latest exposure).

    The index date is a per-person max (partial aggregation, one row per person) joined
    back -- a person with a third of all rows is split by the skew-join, never buffered
    whole in one window. The packed list is bounded by the vocabulary (``collect_set``
    combines map-side). ``exposures`` is read twice: pass a materialised frame if it is
    the result of joins.
    """
    if index_date is None:
        index_date = exposures.groupBy(by).agg(F.max(date).alias("_idx"))
    else:
        index_date = index_date.select(by, F.col(index_date.columns[1]).alias("_idx"))
    x = exposures.join(index_date, by)
    x = x.where(F.col(date) >= F.add_months(F.col("_idx"), -months))
    return x.groupBy(by).agg(
        F.array_join(F.array_sort(F.collect_set(name)), sep).alias(out),
        F.size(F.collect_set(name)).cast("long").alias("n_names"))


# ---------------------------------------------------------------- set ops, dedupe, profile
def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct union."""
    return a.unionByName(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a not in b (EXCEPT DISTINCT)."""
    return a.select(*b.columns).subtract(b)


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in a stated order (``dropDuplicates`` keeps an
    arbitrary one). A key held by a third of all rows still sends at most one row per
    map task thanks to the partial window-group limit."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column (e.g. texts before embedding)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row count and per-column null count in one pass, one row out."""
    cols = list(cols or df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in cols])
