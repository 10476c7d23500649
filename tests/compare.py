"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

    python -m tests.compare [-s FOLDER] [name or prefix ...]
"""
from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from lotscope.bindings import TABLES


def session(cpus: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("lotscope")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else f"{v:.1f}"
    return f"{type(v).__name__}:{v}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data), sorted(columns)


def check(spark, folder, job, sql):
    start = time.time()
    df = job(spark, folder)
    got, got_cols = rows(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(got)}", took, True
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, want_cols = rows(names, cur.fetchall())
    con.close()
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}", took, False
    if got != want:
        have, need = set(got), set(want)
        only_got = [r for r in got if r not in need][:3]
        only_want = [r for r in want if r not in have][:3]
        return f"ROWS {len(got)} vs {len(want)}\n   spark {only_got}\n   sql   {only_want}\n   cols {got_cols}", took, False
    return f"ok {len(got)}", took, True


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    spark, qs, sqls = session(), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, job in qs.items():
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        try:
            text, took, ok = check(spark, a.s, job, sqls.get(name))
        except Exception as exc:
            text, took, ok = "ERROR " + str(exc)[:900] + traceback.format_exc()[-300:], 0, False
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:34s} {took:6.1f}s {text}", flush=True)
    print(f"{bad} bad of {len(qs)}")


if __name__ == "__main__":
    main()
