"""Every query with an SQL equivalent against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from recordloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        if isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind == "b":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf":
            return repr(round(float(x), 9))
        return str(x)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) <= set(entry.queries())
