import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

from talusgrid.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
