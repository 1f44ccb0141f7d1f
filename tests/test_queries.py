"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry_points
from spoolsift.plans.catalog import QUERIES
from tests.compare import database, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, name):
    expected = sql_rows(database(SF_DIR), entry_points.oracle_sql()[name])
    assert spark_rows(entry_points.queries()[name](spark, SF_DIR)) == expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
