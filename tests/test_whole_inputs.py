"""Queries over all rows of their input against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["s7_resolve_all_pages"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    sql = entry.oracle_sql()[name]
    for table in ("orders", "customer", "nation", "region", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{entry.SMALL}/{table}.parquet'")
    got = entry.queries()[name](spark, entry.SMALL)
    want = db.execute(sql)
    columns = [c[0] for c in want.description]
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(want.fetchall())
