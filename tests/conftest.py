import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from chunkwise.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=4, app="chunkwise-tests")
    yield s
    s.stop()
