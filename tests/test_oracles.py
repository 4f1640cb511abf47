"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pytest

from lorebase.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)
    assert got == want


def test_names_are_unique_and_complete():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 80
