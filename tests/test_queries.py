"""Every query with an SQL counterpart gives the same rows as DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from tests import sql_check

SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return sql_check.connect(folder)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[0] == "column" and df.count() > 0


def test_names():
    assert set(SQL) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, folder, name):
    status, _, _, note = sql_check.compare(spark, duck, folder, name)
    assert status == "ok" and not note, note
