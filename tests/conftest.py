import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from glosswork.session import local_session, local_table  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, app="tests", shuffle_partitions=4, memory="8g")


@pytest.fixture
def make(spark):
    """Small literal tables."""
    return lambda rows, schema: local_table(spark, rows, schema)


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
