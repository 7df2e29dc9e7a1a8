"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import differences

import __spark_entry__ as spark_entry

FOLDER = spark_entry.SMALLEST
SQL = spark_entry.oracle_sql()


@pytest.mark.parametrize("name", list(spark_entry.queries()))
def test_query_matches_sql(spark, name):
    problem, _, _ = differences(spark, FOLDER, name, spark_entry.queries()[name], SQL.get(name))
    assert not problem


def test_entry_has_rows(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(spark_entry.queries())
