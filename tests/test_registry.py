"""Every registered query against its SQL counterpart on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from registry.compare import compare

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    assert compare(spark, sf, QUERIES[name], ORACLE.get(name)) is None


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 120
