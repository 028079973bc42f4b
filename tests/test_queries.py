"""Every registered query against its SQL in another engine, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lexigraph.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, other, name):
    got = catalogue.QUERIES[name](spark, str(FOLDER))
    want = other.sql(catalogue.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    a = sorted(key(r[c] for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert a == sorted(key(r[k] for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, str(FOLDER)).collect()
