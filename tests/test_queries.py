"""Every registered query against its SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.compare import check

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    text, _, ok = check(spark, "/root/testdata/sf0.001", QUERIES[name], SQL.get(name))
    assert ok, text


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
