"""One small session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    from findery.session import local_session

    session = local_session(4, 4)
    yield session
    from findery.sources.scratch import release

    release()


@pytest.fixture
def small(spark):
    """A function from rows to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
