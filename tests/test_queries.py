"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from recollect.plans.registry import QUERIES, SQL
from twins import compared, connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    got, wanted = compared(QUERIES[name](spark, SF), con, SQL[name])
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
