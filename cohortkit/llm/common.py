"""Small helpers shared by the text operators."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.session import checkpoint_dir


ARROW_ROWS = 1000              # rows of whole texts that enter a task together


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of the session's Arrow batches: Spark's 10,000 whole texts lie in the
    JVM's and the worker's memory several times. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def ship_by_value(module: str) -> None:
    """Send the module's functions inside the task, so that executors need no install."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[module])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The files survive lost executors, cut the lineage and let later scans prune
    columns. They are removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, remainder 2 of 4; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fitting_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only where the counted rows times the row width stay under
    ``limit`` bytes; otherwise the join is left to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def text_key(text: str | Column = "text") -> Column:
    """Stands for a row's text beside its id."""
    return F.xxhash64(text_or_empty(text)).alias("tk")


def without_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text key are in ``keys`` (doc_id, tk)."""
    return _by_keys(docs, keys, id_col, text_col, "left_anti")


def only_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _by_keys(docs, keys, id_col, text_col, "left_semi")


def _by_keys(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    keys = staged(keys.select(F.col("doc_id").alias("__id"), F.col("tk").alias("__tk")).distinct(), "keys")
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(text_or_empty(docs[text_col])) == F.col("__tk"))
    return docs.join(fitting_broadcast(keys, keys.count(), 40), same, how)
