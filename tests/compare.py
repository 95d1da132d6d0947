"""Run registered queries against their SQL counterparts in DuckDB.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name, fn, sql):
    """(ok, seconds, message)"""
    t0 = time.time()
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sec = time.time() - t0
    if sql is None:
        return True, sec, f"{len(got)} rows, no SQL"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return False, sec, f"columns {got_cols} / {want_cols}"
    if got == want:
        return True, sec, f"{len(got)} rows"
    a, b = set(map(repr, got)), set(map(repr, want))
    only = "\n      spark ".join([""] + sorted(a - b)[:3]) + "\n      sql   ".join([""] + sorted(b - a)[:3])
    return False, sec, f"rows {len(got)} / {len(want)}{only}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as E

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    bad = 0
    for name, fn in E.queries().items():
        if args and name not in args:
            continue
        try:
            ok, sec, msg = compare(spark, con, sf, name, fn, E.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            ok, sec, msg = False, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {sec:6.2f}s  {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
