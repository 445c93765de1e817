"""Every query with SQL against DuckDB on the smallest tables; the driver does the same on larger ones."""

import glob
import math

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) and math.isfinite(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == columns
    expected = [tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()]
    assert plain([tuple(r) for r in df.select(*columns).collect()]) == plain(expected)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
