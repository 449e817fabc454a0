import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tickframe.session import build_session

    ckpt = tempfile.mkdtemp(prefix="tickframe-test-ckpt-", dir="/tmp")
    s = build_session("local[*]", 8, app="tickframe-tests", extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()
