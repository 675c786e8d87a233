import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from driftlock.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, "8g")


@pytest.fixture
def value(spark):
    """Evaluate one column expression on one row."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()[0]

    return run
