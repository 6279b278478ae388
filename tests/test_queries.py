"""Every registered query of the library runs on sf0.001 and equals its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tidewater.plans import kv_queries, source_queries, stream_queries, vector_queries

SF = "/root/testdata/sf0.001"
PLANS = [vector_queries, kv_queries, source_queries, stream_queries]
NAMES = [(p, n) for p in PLANS for n in p.QUERIES]


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("plan,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, duck, plan, name):
    df = plan.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in plan.SQL:
        return
    want = duck.sql(plan.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
