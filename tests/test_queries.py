"""Every registered query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pytest

from groundwell.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, data, name):
    df = plans.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    rel = duck.sql(plans.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert found == sorted(str([plain(row[k]) for k in at]) for row in rel.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
