import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shelfspark.session import build_session, ensure_checkpoint_dir
    s = build_session("local[*]", app="shelfspark-tests", shuffle_partitions=8)
    # tests set their own checkpoint folder only when the session names none
    ensure_checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="shelfspark-ckpt-"))
    yield s
    s.stop()
