"""An embedding cache in buckets (I3, J5, J7): new texts are compared without moving the cache.

The cache is an external Parquet table clustered and sorted by text key. A comparison with
it shuffles the new texts' keys into the cache's buckets; the cache itself is read bucket by
bucket, without an exchange, however large it has grown. Rows are only ever appended, as new
files of the same buckets. Two writers that both miss a text append it twice; reading takes
one row per key and model, again without an exchange, so the result does not depend on who
wrote what, or on a write that is repeated after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators.embed import CACHE_SCHEMA, check_columns, text_key


class BucketedCache:
    """The cache at ``path`` (a shared folder), known to the session's catalog as ``name``.
    ``buckets`` is fixed when the folder is first used: at 100 TB of texts some thousands, so
    that a bucket's keys fit a task."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 256):
        self.spark, self.name, self.buckets = spark, name, buckets
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CACHE_SCHEMA.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet CLUSTERED BY (text_key) "
                  f"SORTED BY (text_key) INTO {int(buckets)} BUCKETS LOCATION '{path}'")

    def rows(self, model: str) -> DataFrame:
        """text_key and vector, one row per key; equal keys lie in one bucket."""
        found = self.spark.table(self.name).where(F.col("model") == model)
        return found.groupBy("text_key").agg(F.first("vector").alias("vector"))

    def missing(self, df: DataFrame, text_col: str, model: str) -> DataFrame:
        """Distinct (text_key, text) that the cache has no vector of."""
        check_columns(df, [text_col])
        keys = (df.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
                .select(text_key("text").alias("text_key"), "text"))
        distinct = keys.repartition(self.buckets, "text_key").dropDuplicates(["text_key"])
        held = self.spark.table(self.name).where(F.col("model") == model).select("text_key")
        return distinct.join(held.hint("merge"), "text_key", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """One new file per bucket that has rows."""
        out = rows.select(*[F.col(f.name).cast(f.dataType) for f in CACHE_SCHEMA.fields])
        out.repartition(self.buckets, "text_key").sortWithinPartitions("text_key").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def update(self, df: DataFrame, text_col: str, encoder) -> None:
        """Encode what is missing and append it."""
        new = encoder.encode(self.missing(df, text_col, encoder.name), "text", "vector")
        self.append(new.select(F.lit(encoder.name).alias("model"), "text_key", "vector"))

    def attach(self, df: DataFrame, text_col: str, model: str) -> DataFrame:
        """``df`` with each row's text_key and vector (null where the text is null)."""
        keyed = df.withColumn("text_key", text_key(text_col)).repartition(self.buckets, "text_key")
        return keyed.join(self.rows(model).hint("merge"), "text_key", "left")
