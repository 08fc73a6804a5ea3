"""Dictionaries of categorical levels that never leave the executors.

A dictionary is a table (column, level, code): the reference level has code 0, the other
levels 1, 2, ... in alphabetical order. The order is found in two levels: the distinct
levels are dealt out by range, numbered inside their range, and each range's offset is the
running total of the ranges before it (a table of columns x partitions). Codes are joined
back on the value. Nothing depends on the number of levels but table sizes: no level list
reaches the driver, and no expression grows with the vocabulary.

Null is no level. Levels are compared as strings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import materialise

BROADCAST_BYTES = 64 << 20


def stacked_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct (column, level) of several columns in one pass, combined before the shuffle."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level"))
                               for c in cols])).alias("s")
    return df.select(pair).select("s.column", "s.level").where(F.col("level").isNotNull()).distinct()


def ranked(levels: DataFrame, by: str, value: str, out: str, partitions: int | None = None) -> DataFrame:
    """Number the distinct rows (by, value) from 1 within ``by``, in the order of ``value``."""
    n = partitions or int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # written once: a later job must find each row in the range that its offset was counted for
    placed = materialise(levels.repartitionByRange(n, by, value).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
               .select(by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(value))
    return (placed.withColumn("_at", inside).join(offsets, [by, "_range"])
            .withColumn(out, F.col("_offset") + F.col("_at")).drop("_range", "_at", "_offset"))


def build(df: DataFrame, references: Mapping[str, object], partitions: int | None = None) -> DataFrame:
    """(column, level, code) for ``{column: reference level or None}``. An absent reference
    leaves code 0 unused."""
    levels = stacked_levels(df, list(references))
    known = [F.when((F.col("column") == c) & (F.col("level") == str(r)), True) for c, r in references.items() if r is not None]
    is_ref = F.coalesce(*known, F.lit(False))
    levels = materialise(levels.withColumn("_ref", is_ref))
    rest = ranked(levels.where(~F.col("_ref")).drop("_ref"), "column", "level", "code", partitions)
    zero = levels.where("_ref").select("column", "level", F.lit(0).cast("long").alias("code"))
    return materialise(rest.select("column", "level", F.col("code").cast("long")).unionByName(zero))


def sizes(dictionary: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Levels per column: one number each."""
    found = {r["column"]: int(r["count"]) for r in dictionary.groupBy("column").count().collect()}
    return {c: found.get(c, 0) for c in cols}


def encode(df: DataFrame, dictionary: DataFrame, cols: Mapping[str, str], missing: int | Column = -1) -> DataFrame:
    """Add ``{column: code column}``; a null or a level not in the dictionary gets
    ``missing``. The dictionary's measured size decides between a broadcast and a join on
    the value, where a level of very many rows is split by the adaptive skew join."""
    other = missing if isinstance(missing, Column) else F.lit(missing)
    measured = {r["column"]: r["bytes"] for r in dictionary.groupBy("column").agg(
        F.sum(F.octet_length("level") + 48).alias("bytes")).collect()}
    for i, (c, out) in enumerate(cols.items()):
        level, code = f"_level{i}", f"_code{i}"
        side = dictionary.where(F.col("column") == c).select(F.col("level").alias(level), F.col("code").alias(code))
        side = F.broadcast(side) if measured.get(c, 0) <= BROADCAST_BYTES else side
        joined = df.join(side, F.col(f"`{c}`").cast("string") == F.col(level), "left")
        df = joined.withColumn(out, F.coalesce(F.col(code), other).cast("int")).drop(level, code)
    return df


class OneHotIndex:
    """F1's first stage: index columns for the one-hot encoder from a dictionary without
    references. Unseen values and null get the index after the last level, which the encoder
    drops, so they become all zeros."""

    def __init__(self, dictionary: DataFrame, cols: Sequence[str], outs: Sequence[str]):
        self.dictionary, self.cols, self.outs = dictionary, list(cols), list(outs)
        self.sizes = sizes(dictionary, cols)
        self.uid = "OneHotIndex"

    def transform(self, df: DataFrame) -> DataFrame:
        for c, out in zip(self.cols, self.outs):
            df = encode(df, self.dictionary, {c: out}, missing=self.sizes[c] + 1)
            df = df.withColumn(out, (F.col(out) - 1).cast("double"))
        return df


def one_hot_long(df: DataFrame, key: str, dictionary: DataFrame, cols: Sequence[str], out: str = "feature_id") -> DataFrame:
    """F1 for any vocabulary: (key, feature id) of each one in the one-hot matrix. The ids of
    a column follow those of the columns before it; a null or unseen value has no row."""
    start, width = 0, sizes(dictionary, cols)
    ids = []
    for c in cols:
        ids.append(F.col(f"_id_{c}") - 1 + F.lit(start).cast("long"))
        start += width[c]
    coded = encode(df.select(key, *cols), dictionary, {c: f"_id_{c}" for c in cols}, missing=F.lit(None).cast("long"))
    return coded.select(key, F.explode(F.array_compact(F.array(*ids))).alias(out))
