"""Every registered query of the subpackage; with SQL, against it."""

import pytest

from tablehaul.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_with_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
