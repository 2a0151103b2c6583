import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from htmlframe.session import local_session

    return local_session(cores=int(os.environ.get("TEST_CPUS", "4")), partitions=4, memory="3g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
