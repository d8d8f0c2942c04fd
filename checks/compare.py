"""Compare registered queries with their SQL: python -m checks.compare [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb

from checks import oracle
from checks.queries import QUERIES
from srcatlas.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(row[i]) for i in order) for row in rows])


def main(sf_dir: str, names: list[str]) -> int:
    spark = local_session(8, "compare")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    statements, wrong = oracle.statements(), 0
    for name in names or list(QUERIES):
        began = time.time()
        df = QUERIES[name](spark, sf_dir)
        got = rows_of(df.columns, df.collect())
        took = time.time() - began
        if name not in statements:
            print(f"{name}: {len(got)} rows, no SQL, {took:.1f}s", flush=True)
            continue
        answer = con.execute(statements[name])
        columns = [d[0] for d in answer.description]
        want = rows_of(columns, answer.fetchall())
        types = {d[0]: str(d[1]) for d in answer.description}
        ok = sorted(columns) == sorted(df.columns) and got == want
        note = ""
        if not ok:
            wrong += 1
            extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
            note = f"\n  columns {sorted(df.columns)} / {sorted(columns)}\n  spark only {extra}\n  sql only {missing}"
        spark_types = dict(df.dtypes)
        odd = {c: (spark_types.get(c), t) for c, t in types.items() if (spark_types.get(c), t) not in {
            ("string", "VARCHAR"), ("int", "INTEGER"), ("bigint", "BIGINT"), ("boolean", "BOOLEAN")}}
        print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)}/{len(want)} rows, {took:.1f}s {odd or ''}{note}"[:1500], flush=True)
    return wrong


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    sys.exit(main(folder, arguments))
