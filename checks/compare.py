"""Run registered queries on both engines and compare: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import hashlib
import os
import sys
import time

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float):
            return f"{v:.6g}" if v == v else "nan"
        return str(v)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, names=None, verbose=True):
    from .registered import ORACLE, QUERIES
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = []
    for name in names or QUERIES:
        try:
            t = time.time()
            df = QUERIES[name](spark, sf_dir)
            columns, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
            spent = time.time() - t
            if name not in ORACLE:
                print(f"rows  {name}: {len(rows)} in {spent:.1f}s", flush=True)
                continue
            t = time.time()
            cur = con.execute(ORACLE[name])
            want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
            other = time.time() - t
        except Exception as e:
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:700]}", flush=True)
            continue
        ok = columns == want_cols and rows == want
        print(f"{'ok   ' if ok else 'DIFF '} {name}: {len(rows)}/{len(want)} in {spent:.1f}s / {other:.1f}s", flush=True)
        if not ok:
            bad.append(name)
            if columns != want_cols:
                print("   columns", columns, want_cols)
            a, b = set(rows), set(want)
            for r in sorted(a - b)[:3]:
                print("   spark ", str(r)[:400])
            for r in sorted(b - a)[:3]:
                print("   duckdb", str(r)[:400])
            print("   only spark", len(a - b), "only duckdb", len(b - a))
    print("BAD", bad)
    return bad


if __name__ == "__main__":
    from postings_engine.session import build_session
    spark = build_session("local[8]", 8, extra={"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    picked = args or None
    if picked:
        from .registered import QUERIES
        picked = [n for n in QUERIES if any(n.startswith(p) for p in picked)]
    sys.exit(1 if compare(spark, sf, picked) else 0)
