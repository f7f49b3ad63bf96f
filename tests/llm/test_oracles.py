"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from mailspark.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{table}'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want and want
