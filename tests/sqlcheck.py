"""Runs registered queries against their SQL counterparts and compares the rows.

``python tests/sqlcheck.py FOLDER [query ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(round(float(value), 5) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10] if value.isoformat().endswith("T00:00:00") else value.isoformat()
    return str(value)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, folder: str) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got, want = normal(df.columns, got_rows), normal(names, want_rows)
    if got == want:
        return None
    a, b = set(got), set(want)
    return f"rows {len(got)} / {len(want)}; spark only {len(a - b)}: {sorted(a - b)[:2]}; sql only {len(b - a)}: {sorted(b - a)[:2]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from fathomline.session import local_session

    folder, only = sys.argv[1], set(sys.argv[2:])
    spark, con = local_session("sqlcheck"), connect(folder)
    bad = 0
    sql = oracle_sql()
    for name, fn in queries().items():
        if (only and name not in only) or name not in sql:
            continue
        start = time.time()
        try:
            diff = compare(spark, con, fn, sql[name], folder)
        except Exception as error:
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - start:.1f}s {(diff or '')[:1500]}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
