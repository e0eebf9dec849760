import functools
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from rillmeter.catalog import tables  # noqa: E402
from rillmeter.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "rillmeter-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session", autouse=True)
def shared_tables():
    """Let the named queries share their stored starting tables; each builds its own outside the tests."""
    for name in ("stored_features", "stored_usage", "stored_final", "scaled"):
        setattr(tables, name, functools.lru_cache(getattr(tables, name)))


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
