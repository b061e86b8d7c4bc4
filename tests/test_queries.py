"""Every query of the core against its SQL, and the entry module."""

import pytest

import __spark_entry__ as entry
from findery.plans import catalogue
from tests.oracles import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    columns, rows = rows_of(catalogue.queries()[name](spark, FOLDER))
    if name in SQL:
        assert (columns, rows) == rows_of_sql(FOLDER, SQL[name])
    else:
        assert columns


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_routing_agrees_with_the_log(spark):
    assert catalogue.queries()["misrouted"](spark, FOLDER).count() == 0
