"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from sparsemill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        want = db.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
