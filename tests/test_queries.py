"""Every registered query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__ as registry
from compare import connect, difference

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folder, con, name):
    got = QUERIES[name](spark, folder).toPandas()
    if name in ORACLES:
        assert difference(got, con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert registry.entry(spark).count() > 0
