import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from evalspark.session import local_session

    s = local_session(4, shuffle_partitions=4, app="evalspark-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="evalspark-test-")


SF_SMALL = "/root/testdata/sf0.001"
