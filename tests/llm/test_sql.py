"""Corpus queries that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from groundwell.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=str) == sorted(rel.fetchall(), key=str)
