"""Every query of the core runs on the smallest tables and gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from quire.plans import engine_queries, problems, queries

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")
ALL = {**queries.queries(), **engine_queries.queries(), **problems.queries()}
SQL = {**queries.oracle_sql(), **engine_queries.oracle_sql(), **problems.oracle_sql()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    df = ALL[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        con = duck.execute(SQL[name])
        at = [[d[0] for d in con.description].index(c) for c in columns]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in con.fetchall()), key=repr)
