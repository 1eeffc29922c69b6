"""Queries with SQL agree with it over whole tables."""

import pytest
from compare import compare, views

from pageloom.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    good, note = compare(spark, views(SF_DIR), name, SF_DIR, queries.QUERIES[name], queries.SQL[name])
    assert good, note
