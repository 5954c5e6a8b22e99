"""Compare a registered query with its SQL counterpart in DuckDB.

Run as a script: ``python tests/oracle_check.py FOLDER [name-part ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.10g}")
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder):
    import duckdb

    from itemspark.fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def kind(t: str) -> str:
    t = t.lower()
    for prefix in ("decimal", "timestamp"):
        if t.startswith(prefix):
            return prefix
    return {"bigint": "int", "int": "int", "integer": "int", "hugeint": "HUGEINT", "varchar": "string"}.get(t, t)


def compare(spark, con, name, folder):
    """Return (message or None, number of rows)."""
    from itemspark.catalog import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    rows = df.collect()
    if name not in ORACLES:
        return None, len(rows)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    types = {c[0]: kind(str(c[1])) for c in cur.description}
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows)
    odd = {c: (t, types[c]) for c, t in df.dtypes if kind(t) != types[c]}
    if odd:
        return f"types {odd}", len(rows)
    got, want = normal([tuple(r) for r in rows], df.columns), normal(want, names)
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else []
        only_want = [r for r in want if r not in set(got)][:3] if len(got) < 20000 else []
        return f"rows {len(got)} vs {len(want)}; spark only {only_got}; sql only {only_want}; cols {sorted(names)}", len(rows)
    return None, len(rows)


if __name__ == "__main__":
    from itemspark.catalog import ORACLES, QUERIES
    from itemspark.session import local_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in QUERIES:
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t0 = time.time()
        try:
            message, n = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            message, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += message is not None
        flag = "ok  " if message is None else "FAIL"
        weak = "" if name in ORACLES else " (no sql)"
        print(f"{flag} {name} rows={n} {time.time() - t0:.1f}s{weak}" + (f"\n     {message}" if message else ""), flush=True)
    print("failures:", bad)
