import os

import pytest

import __spark_entry__ as entry
from inkwell.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(_plain(r[c]) for c in columns)) for r in frame.collect()) == sorted(str(tuple(_plain(r[i]) for i in order)) for r in want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
