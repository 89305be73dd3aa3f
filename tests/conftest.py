import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import local_session

    return local_session(os.environ.get("TEST_CPUS", "8"), 8, "tests")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
