"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from suite.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def engine():
    from suite.compare import connect

    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, engine, name):
    from suite.compare import compare

    status, n, _, detail = compare(spark, engine, SF, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert status.startswith("ok") or status == "rows-only", (status, detail)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(contract.queries()) >= set(QUERIES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["issue_date", "section", "section_order", "position", "seq", "title"]
    assert df.count() > 0
