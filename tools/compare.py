"""Run registered queries against DuckDB on one data directory and report differences.

    python tools/compare.py [--sf /root/testdata/sf0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def difference(spark_df, con, sql):
    got, names = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    kinds = {c: str(d[1]) for c, d in zip([d[0] for d in cur.description], cur.description)}
    wide = [c for c, t in kinds.items() if "HUGEINT" in t or "DECIMAL" in t]
    if names != want_names:
        return f"columns {names} != {want_names}"
    if wide:
        return f"wide SQL types {wide}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows vs {len(want)}; spark only {extra}; sql only {missing}"
    return None if got else "EMPTY"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from ledgerloom.plans.registry import oracle_sql, queries
    from ledgerloom.session import build_session

    spark = build_session(master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    sql, bad = oracle_sql(), 0
    for name, plan in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = plan(spark, args.sf)
            note = difference(df, con, sql[name]) if name in sql else (
                None if df.count() else "EMPTY")
        except Exception as exc:  # report and go on with the next query
            note = f"{type(exc).__name__}: {str(exc)[:1500]}"
        took = time.time() - start
        if note:
            bad += 1
        print(f"{'FAIL' if note else 'ok  '} {name:40s} {took:6.2f}s {'' if name in sql else '(rows only) '}{note or ''}",
              flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
