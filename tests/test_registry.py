"""Every registered query agrees with its SQL on DuckDB over whole tables."""

import pytest
from compare import compare, views

from checks import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, SF_DIR, QUERIES[name], SQL.get(name))
    assert good, note


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
