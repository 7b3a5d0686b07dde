import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from linkweave.session import get_session, release

    s = get_session(cores="4", shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()


def pytest_configure(config):
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
