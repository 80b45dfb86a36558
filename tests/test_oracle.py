"""Every query against its SQL twin in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from sunloom import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    mine = __spark_entry__.queries()[name](spark, DATA).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(mine)
        return
    theirs = db.sql(sql).df()
    names = sorted(mine.columns)
    assert names == sorted(theirs.columns) and len(mine) == len(theirs)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (mine, theirs))
    assert all(((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all() for c in names)
