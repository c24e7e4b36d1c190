import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()
