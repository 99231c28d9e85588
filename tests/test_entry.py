"""The driver's contract, and every linkage query against its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.plans import linkage, oracle

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(linkage.QUERIES) == set(oracle.ORACLES)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    text = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.sql(oracle.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
