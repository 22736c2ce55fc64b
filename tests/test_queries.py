"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from tablehaul.workload.registry import ORACLES, QUERIES
from tests.oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name != "bulk_extract":  # which deals its rows out as asked
        assert "RoundRobinPartitioning" not in df._jdf.queryExecution().toString()
    assert differences(df, duck, ORACLES[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 1
