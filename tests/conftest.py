import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kestrel.session import build_session
    s = build_session("local[*]", app="kestrel-tests", shuffle_partitions=8)
    # tests set their own checkpoint folder; a cluster names a shared one
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kestrel-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from kestrel.sources.tables import scratch_path
    import uuid
    return scratch_path(spark, f"test-{uuid.uuid4().hex}")
