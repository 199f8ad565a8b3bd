"""Every registered query against its SQL on the smallest tables."""

import pytest

from oracle_check import compare, connect
from tallybook.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, key):
    problem = compare(catalogue.QUERIES[key](spark, SF_DIR), con, catalogue.ORACLES[key])
    assert problem is None, problem


@pytest.mark.parametrize("key", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, key):
    assert not catalogue.QUERIES[key](spark, SF_DIR).isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
