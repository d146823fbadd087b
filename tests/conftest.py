import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from rightsize.session import local_session
    s = local_session(cpus="*", shuffle_partitions=8, app_name="rightsize-tests")
    yield s
    s.stop()
