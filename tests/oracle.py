"""Compare registered queries with their SQL twins in DuckDB.

``python -m tests.oracle [--sf sf0.01] [name ...]`` prints one line per query.
"""
from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

ROOT = "/root/testdata"


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = canonical(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sum(x != y for x, y in zip(got, want))} of {len(got)} rows differ, cols {got_cols}\n   spark {a}\n   sql   {b}"
    return None


def main(argv=None):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import logging
    logging.disable(logging.CRITICAL)
    from tests.conftest import make_session
    import __spark_entry__ as e
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    spark, con = make_session(), duck(f"{ROOT}/{args.sf}")
    q, s = e.queries(), e.oracle_sql()
    names = [n for n in q if not args.names or any(n.startswith(a) for a in args.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            msg = compare(spark, con, q[n], s[n], f"{ROOT}/{args.sf}") if n in s else f"rows only: {q[n](spark, f'{ROOT}/{args.sf}').count()}"
        except Exception as ex:  # noqa: BLE001 - report and go on
            msg = f"ERROR {type(ex).__name__}: {str(ex)[:600]}"
        ok = msg is None or msg.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t0:.1f}s {msg or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
