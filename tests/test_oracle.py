"""Every registered query beside its SQL oracle on the smallest test tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import compare, oracle_connection  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SF_SMALL).exists(), reason="no test tables")
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF_SMALL)


def test_entry(spark):
    assert contract.entry(spark).count() == 25


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, oracle, name):
    assert compare(QUERIES[name](spark, SF_SMALL), oracle, ORACLES[name]) == "ok"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0
