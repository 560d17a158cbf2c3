import os

import duckdb
import pytest

from tickforge import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    assert got == sorted(want, key=str)
