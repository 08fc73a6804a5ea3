"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: adaptive execution (runtime coalescing, skew-join
# splitting, broadcast conversion from measured sizes) and UTC timestamps.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of frames that went out of scope are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(total_cores: int, input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Sizing for a large cluster: shuffle partitions so each reduce task handles about
    ``target_partition_bytes`` of the input (never fewer than 3 waves of the cores),
    the same split size for scans, AQE coalescing toward it, and skew-join splitting
    for partitions 5x over the median. Pass the result as ``get_spark(extra=...)``."""
    parts = max(3 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def get_spark(master: str | None = None, app: str = "cohortkit",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster ``master`` stays ``None`` so the launcher decides; tests pass ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only when it is unset (local tests) a fresh
    scratch folder is created and registered, so ``DataFrame.checkpoint()`` and
    stage tables written by the operators land somewhere every executor can read.
    Executors of a cluster cannot read each other's disks, so there an unset folder raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="cohortkit-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return sc.getCheckpointDir() or local


def materialise(df):
    """Write ``df`` once to the shared checkpoint folder and continue from the files
    (reliable checkpoint: survives executor loss and cuts the lineage). Used for
    frames that several jobs read, so the joins behind them run once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
