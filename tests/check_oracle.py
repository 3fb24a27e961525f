"""Compare registered queries with their SQL: python tests/check_oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paideon.plans import all_queries  # noqa: E402
from paideon.session import local_session  # noqa: E402
from paideon.sources.model_tables import DRIVER_TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if hasattr(value, "is_integer") or isinstance(value, int):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, folder):
    """(spark rows, problem or None, seconds)"""
    began = time.time()
    df = query.run(spark, folder)
    got = df.collect()
    spent = time.time() - began
    sql = query.oracle()
    if sql is None:
        return len(got), None, spent
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}", spent
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return len(got), f"{len(a)} vs {len(b)} rows; spark only {only_a}; sql only {only_b}", spent
    return len(got), None, spent


if __name__ == "__main__":
    where, wanted = sys.argv[1], sys.argv[2:]
    session, db = local_session(8), connect(where)
    bad = 0
    for name, entry in all_queries().items():
        if wanted and name not in wanted:
            continue
        try:
            count, problem, seconds = compare(session, db, entry, where)
        except Exception as error:  # noqa: BLE001
            count, problem, seconds = -1, f"{type(error).__name__}: {str(error)[:500]}", 0.0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if entry.sql else "rows")
        print(f"{mark:5} {name:34} {count:8} {seconds:6.2f}s {problem or ''}", flush=True)
    print("failed:", bad)
