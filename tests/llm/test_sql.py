"""The queries that SQL can express against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift.llm import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    text = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def test_all_queries_are_registered():
    assert set(queries.queries()) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())
    assert len(queries.queries()) == 11


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert rows(got) == rows(want)
