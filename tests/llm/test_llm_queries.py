"""Every query of the package runs on the smallest tables and gives the rows of its SQL."""

import os

import duckdb
import pytest

from quire.llm import queries

DATA = os.environ.get("QUIRE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    if name in queries.oracle_sql():
        con = duck.execute(queries.oracle_sql()[name])
        at = [[d[0] for d in con.description].index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in at) for r in con.fetchall()), key=repr)
