"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from checks import oracle
from checks.compare import TABLES, rows_of
from checks.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_all_have_sql():
    assert set(oracle.statements()) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    answer = con.execute(oracle.statements()[name])
    columns = [d[0] for d in answer.description]
    want = rows_of(columns, answer.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got and got == want


def test_tree_info_counts_what_is_in_the_files(spark):
    rows = QUERIES["tree_info"](spark, FOLDER).collect()
    assert {"files", "functions", "calls", "imports", "strings", "resolved_calls"} <= {r["measure"] for r in rows}
    assert any(r["measure"].startswith("language:") for r in rows)
