import oracle_llm
import pytest

from driftlock.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    ok, message, _ = oracle_llm.compare(spark, "/root/testdata/sf0.001", name)
    assert ok, message


def test_every_operator_has_one_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
