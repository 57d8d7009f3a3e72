"""Every registered query against its reference SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import connect, differences
from tickweave.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(set(QUERIES) & set(registry.QUERIES))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert differences(got, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "day", "ts_ms", "net_flow_60s", "imbalance_10_ticks"] and df.count() > 0


def test_every_query_has_sql():
    assert set(OWN) == set(registry.SQL)
