"""Incremental embedding cache as a Structured Streaming job (I3 run continuously).

New text files land in a source folder; each micro-batch embeds only the texts whose
key is not cached yet and appends them. The cache table is the state: a replayed
micro-batch (after a failure) finds its rows already cached and appends nothing, so
the sink is idempotent without any extra bookkeeping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortkit.operators import embed as EM
from cohortkit.session import checkpoint_dir


def start(spark: SparkSession, source_dir: str, schema: T.StructType, text_col: str, cache_path: str,
          encoder=None, checkpoint_location: str | None = None, available_now: bool = True,
          processing_time: str | None = None) -> StreamingQuery:
    """Start the stream. ``available_now`` processes what is there and stops (batch-like
    scheduling with streaming bookkeeping); otherwise ``processing_time`` sets the trigger."""
    encoder = encoder or EM.HashingEncoder()
    loc = checkpoint_location or f"{checkpoint_dir(spark).rstrip('/')}/streams/embed-cache"

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        cache = EM.read_cache(batch.sparkSession, cache_path, encoder.name)
        new = EM.embed_new(batch, text_col, cache, encoder)
        EM.append_cache(new, cache_path)

    w = (spark.readStream.schema(schema).parquet(source_dir)
         .writeStream.foreachBatch(on_batch).option("checkpointLocation", loc))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()
