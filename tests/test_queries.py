"""Every registered query with SQL is compared with it over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from vellum.plans import catalog, textual

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(norm(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() >= 0


@pytest.mark.parametrize("name", sorted(textual.CASES))
def test_cases(spark, duck, name):
    """Edge rows that the tables don't hold."""
    df = textual.CASES[name](spark)
    if name not in textual.CASE_SQL:
        assert df.count() >= 0
        return
    found = duck.execute(textual.CASE_SQL[name])
    order = sorted(columns := [c[0] for c in found.description])
    assert sorted(df.columns) == order
    want = sorted(tuple(norm(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(norm(r[c]) for c in order) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
