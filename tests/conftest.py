import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from saiflow.session import build_session
    s = build_session("local[4]", 4, app="saiflow-tests", extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def spark_session_holder(spark):
    """Same session; a separate name lets hypothesis tests use it (no function-scoped fixture)."""
    return spark
