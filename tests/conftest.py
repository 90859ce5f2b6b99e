import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = {"0.001": "/root/testdata/sf0.001", "0.01": "/root/testdata/sf0.01"}


@pytest.fixture(scope="session")
def spark():
    from horosphere.session import get_spark
    ck = tempfile.mkdtemp(prefix="horosphere-test-ckpt-")
    s = get_spark("local[4]", 8, extra={"spark.checkpoint.dir": ck})
    yield s
    s.stop()
