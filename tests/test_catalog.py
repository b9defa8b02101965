"""Every query with SQL against DuckDB at the smallest scale."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from shelfscan.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def value(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return "NULL" if x is None else str(int(x)) if isinstance(x, bool) else str(x)


def compared(spark, name, fn, sql, con):
    df = fn(spark, str(DATA))
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    got = sorted(tuple(value(r[i]) for i in order) for r in df.collect())
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns), name
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    assert got == sorted(tuple(value(r[i]) for i in order) for r in cur.fetchall()), name


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    compared(spark, name, catalog.QUERIES[name], catalog.SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "size", "mtime", "is_dir", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
