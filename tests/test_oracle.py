"""Every layout query that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from leafgrid.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    assert (a == b).all().all(), a[(a != b).any(axis=1)].head().to_string() + "\n" + b[(a != b).any(axis=1)].head().to_string()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, duck, name):
    same(QUERIES[name](spark, data).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
