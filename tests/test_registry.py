"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, rows_of

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_sql(spark, db, name):
    df = entry.queries()[name](spark, ROOT)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = db.execute(sql)
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    assert cols == want_cols and got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
