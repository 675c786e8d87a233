import pytest

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from driftlock.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql_twin(spark, name):
    ok, message, _ = oracle.compare(spark, SF, name)
    assert ok, message


def test_comparison_notices_a_difference(spark, monkeypatch):
    monkeypatch.setitem(ORACLES, "mark_tested_jn2", ORACLES["mark_tested_jn2"].replace(">= 49", ">= 48"))
    assert not oracle.compare(spark, "/root/testdata/sf0.01", "mark_tested_jn2")[0]
