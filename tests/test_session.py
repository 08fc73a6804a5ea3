"""Session helpers: the cluster's checkpoint folder wins; sizing is sane."""
import pathlib

from cohortkit import session


def test_checkpoint_dir_follows_session(spark):
    d = session.checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() == d or d in spark.sparkContext.getCheckpointDir()
    df = session.materialise(spark.range(10))
    assert df.count() == 10


def test_cluster_conf_scales_with_input():
    c = session.cluster_conf(total_cores=8000, input_bytes=100 << 40)
    assert int(c["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    small = session.cluster_conf(total_cores=8000, input_bytes=1 << 30)
    assert int(small["spark.sql.shuffle.partitions"]) == 24000


def test_no_local_checkpoint_in_library():
    root = pathlib.Path(__file__).resolve().parents[1] / "cohortkit"
    for f in root.rglob("*.py"):
        assert "localCheckpoint(" not in f.read_text(), f
