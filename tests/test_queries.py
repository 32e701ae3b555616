"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connection(FOLDER)


def test_every_inventory_row_has_a_query():
    assert len(entry.queries()) >= 245 and set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    assert check.compare(entry.queries()[name](spark, FOLDER), con.sql(ORACLES[name]), ties=True) == ""
