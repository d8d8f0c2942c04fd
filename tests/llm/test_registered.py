"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

from checks.compare import TABLES, rows_of
from srcatlas.llm.registered import QUERIES
from srcatlas.llm.sql import SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    answer = con.execute(SQL[name])
    columns = [d[0] for d in answer.description]
    want = rows_of(columns, answer.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(columns)
    assert got == want
