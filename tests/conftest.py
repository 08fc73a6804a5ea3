import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortkit.session import get_spark
    s = get_spark("local[*]", app="cohortkit-tests", shuffle_partitions=8)
    # tests own their checkpoint folder (a cluster names a shared one)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ck-test-ckpt-"))
    yield s
    s.stop()


SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
