"""Every query of the library proper against its SQL, over the smallest tables."""

from __future__ import annotations

import pytest

from recollect import catalogue

from .compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, con, name):
    assert difference(spark, name, QUERIES[name], SQL[name], SF, con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
