import glob

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df, found = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    expected = sorted(tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall())
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == expected
