"""Every registered query against its DuckDB oracle on the smallest fixture
(the driver runs the same comparison at sf0.01)."""

import os

import pytest

from relkit.plans.registry import oracle_sql, queries

SF = os.environ.get("RELKIT_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")

_SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    from tools.check_oracle import duck as make
    return make(SF)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_matches_oracle(spark, duck, name):
    from tools.check_oracle import compare
    ok, msg = compare(name, queries()[name](spark, SF), duck, _SQL[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(queries()) - set(_SQL)))
def test_rows_only_queries_run(spark, name):
    assert queries()[name](spark, SF).count() >= 0
