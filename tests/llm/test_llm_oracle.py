"""Queries with SQL against DuckDB."""

import duckdb
import pytest
SF_SMALL = "/root/testdata/sf0.001"

from scriptorium.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    found = queries.queries()[name](spark, SF_SMALL)
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda r: [str(x) for x in r]
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)
