"""Every query that has an SQL twin against it; tests/test_values.py has the others."""

import pytest

from sightline.plans import catalog
from tests.oracle import connect, rows_of, rows_of_sql

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, con, name):
    df = catalog.queries()[name](spark, tables)
    assert rows_of(df) == rows_of_sql(con, SQL[name], df.columns)


def test_queries_without_sql_have_value_tests():
    from tests import test_values

    assert set(catalog.queries()) - set(SQL) == test_values.COVERED


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
