"""Every registered query equals its SQL on the smallest tables."""

import pytest

from tests.oracle import difference, duck, duck_table, spark_table
from tidemill.catalog import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    got = spark_table(all_queries()[name](spark, FOLDER))
    sql = all_oracles().get(name)
    if sql is None:
        assert got[1]
    else:
        assert difference(got, duck_table(con, sql)) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
