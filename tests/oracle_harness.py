"""Run every registered query in Spark and its oracle in DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [key-substring ...]
Comparison: same column names, same row count, same multiset of rows after
sorting columns by name and rounding floats.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from corpusflow.sources.tables import TABLES  # noqa: E402

FLOAT_DIGITS = 6
STRICT = bool(os.environ.get("ORACLE_STRICT"))  # compare floats bit for bit


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if STRICT else round(v, FLOAT_DIGITS) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), FLOAT_DIGITS) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((norm(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    out = [tuple(norm(r[k]) for k in order) for r in rows]
    return sorted(out, key=lambda t: repr(t))


def check(spark, con, key, q, sf_dir):
    t0 = time.time()
    df = q.fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if q.oracle is None:
        return dict(key=key, status="no-oracle", rows=len(s_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(q.oracle)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    info = dict(key=key, rows=len(s_rows), oracle_rows=len(d_rows), spark_s=round(t1 - t0, 2))
    if sorted(s_cols) != sorted(d_cols):
        return dict(info, status="COLS", spark_cols=s_cols, oracle_cols=d_cols)
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if len(a) != len(b):
        return dict(info, status="COUNT")
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return dict(info, status="VALUES", diff=diff)
    return dict(info, status="ok")


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    filt = [a for a in argv[1:] if not a.startswith("/")]
    from corpusflow.plans.registry import all_queries
    from corpusflow.session import build_session

    spark = build_session("local[8]", 8)
    con = duck_con(sf_dir)
    bad = 0
    for key, q in sorted(all_queries().items()):
        if filt and not any(f in key for f in filt):
            continue
        try:
            r = check(spark, con, key, q, sf_dir)
        except Exception as e:  # report and continue
            r = dict(key=key, status="ERROR", error=str(e).splitlines()[0][:300])
        if r["status"] not in ("ok", "no-oracle"):
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
