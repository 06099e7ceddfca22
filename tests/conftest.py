import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from driftwatch.session import get_session
    s = get_session(master="local[4]", app="driftwatch-tests", shuffle_partitions=4)
    yield s
    s.stop()
