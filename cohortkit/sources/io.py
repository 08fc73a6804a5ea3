"""Scans and sinks.

CSV is always read with an explicit schema (no inference pass over the data).
Column names with dots or dashes (``audit.c.score``, ``non-empl.merge``) are
normalised to underscores on read; the dotted form is only restored at a sink.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_COL = "split"


def normalise_name(name: str) -> str:
    return re.sub(r"[.\-]", "_", name)


def normalise_columns(df: DataFrame) -> DataFrame:
    renames = {c: normalise_name(c) for c in df.columns if normalise_name(c) != c}
    return df.withColumnsRenamed(renames) if renames else df


def read_table(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
               fmt: str = "parquet", header: bool = True) -> DataFrame:
    """One scan for a file, a directory or a glob (``survey_*_*.csv``).

    CSV needs ``schema``; with it the scan is a single pass and filters/projections
    still push into the reader.
    """
    reader = spark.read
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV scans need an explicit schema (no inference at scale)")
        reader = reader.schema(schema).option("header", header).option("mode", "FAILFAST")
        df = reader.csv(path)
    elif fmt == "parquet":
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.parquet(*(path if isinstance(path, list) else [path]))
    elif fmt == "json":
        if schema is None:
            raise ValueError("JSON scans need an explicit schema")
        df = reader.schema(schema).json(path)
    else:
        raise ValueError(f"unknown format {fmt}")
    return normalise_columns(df)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] | None = (SPLIT_COL,),
                mode: str = "overwrite") -> None:
    """S3: Parquet sink. Split tables are written ``partitionBy('split')`` so a later
    ``load_split`` reads only its own directory (partition pruning)."""
    cols = [c for c in (partition_by or []) if c in df.columns]
    w = df.write.mode(mode)
    if cols:
        w = w.partitionBy(*cols)
    w.parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The ``train``/``validation``/``test`` slice of a split table."""
    return spark.read.parquet(path).filter(F.col(SPLIT_COL) == F.lit(split))


def select_split(df: DataFrame, split: str) -> DataFrame:
    """P6 on an in-flight frame."""
    return df.filter(F.col(SPLIT_COL) == F.lit(split))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric rows (and predictions as rows, never one giant array) as JSON lines."""
    df.write.mode(mode).json(path)


def to_sink_names(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Restore source-style names (``audit_c_score`` -> ``audit.c.score``) right before a sink."""
    return df.withColumnsRenamed(dict(mapping))


def enrich(base: DataFrame, extra: DataFrame, key: str = "person_id") -> DataFrame:
    """Append label columns to the person table; persons without a label keep nulls."""
    dup = [c for c in extra.columns if c in base.columns and c != key]
    if dup:
        raise ValueError(f"columns already present in the base table: {dup}")
    return base.join(extra, key, "left")


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str,
                   mode: str = "overwrite") -> DataFrame:
    """Person-keyed tables that are joined again and again (persons, pivots, packed
    drugs) written ``bucketBy(buckets, key)`` and sorted within buckets, at an explicit
    (shared) path. Two tables bucketed the same way join on ``key`` with no shuffle on
    either side. Returns the table as read back through the catalog."""
    (df.write.mode(mode).format("parquet").option("path", path)
       .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return df.sparkSession.table(name)
