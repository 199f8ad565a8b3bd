"""Registered queries of the folder against their SQL on the smallest tables."""

import pytest

from oracle_check import compare, connect
from tallybook.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_matches_sql(spark, con, key):
    problem = compare(queries.QUERIES[key](spark, SF_DIR), con, queries.ORACLES[key])
    assert problem is None, problem


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    numbers = sorted(int(k[2:].split("_")[0]) for k in entry.queries() if k.startswith("op") and k[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
