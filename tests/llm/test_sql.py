"""Each query with SQL, over the smallest tables."""

import os

import pytest

from inkwell.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op12_filter_audit"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
