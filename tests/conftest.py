import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build_session
    s = build_session("local[4]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(params=[1, 4, 13], ids=lambda n: f"parts{n}")
def parts(request):
    """Every layout-sensitive test runs at 1, 4 and 13 input partitions."""
    return request.param
