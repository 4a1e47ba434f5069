import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cardlens.session import build_session

    session = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    yield session
    session.stop()


@pytest.fixture(autouse=True, scope="module")
def _no_leftovers():
    """Frames that tests of one module keep in memory are dropped before the next, which may look for leftovers of its own."""
    yield
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is not None:
        session.catalog.clearCache()
