"""Compare a registered query with its SQL. Also a command: python tests/oracle.py [folder] [query ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, plan, sql, sf_dir, read_from=None) -> tuple[int, float, str | None]:
    """Rows, seconds and what differs (None if nothing does). ``read_from`` has the same tables in another form."""
    start = time.time()
    df = plan(spark, read_from or sf_dir)
    got = df.collect()
    took = time.time() - start
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), took, f"columns {sorted(df.columns)} not {sorted(names)}"
    if len(got) != len(expected):
        return len(got), took, f"{len(got)} rows not {len(expected)}"
    mine, theirs = rows_of(df.columns, got), rows_of(names, expected)
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(got), took, f"row {a} not {b}"
    return len(got), took, None


if __name__ == "__main__":
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
    from gavelspark.plans import PLANS, SQL
    from gavelspark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(PLANS)
    session, connection = build_session(cores=8), connect(folder)
    for name in names:
        if name not in SQL:
            print(f"{name:34s} no SQL")
            continue
        try:
            n, took, problem = compare(session, connection, PLANS[name], SQL[name], folder)
            print(f"{name:34s} {n:8d} rows {took:6.2f} s  {problem or 'ok'}", flush=True)
        except Exception as e:  # report and go on
            print(f"{name:34s} FAILED {type(e).__name__}: {str(e)[:600]}", flush=True)
