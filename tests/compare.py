"""Run registered queries and their SQL on the same tables and compare."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf_dir)
    cols, rows = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    cur = con.execute(sql)
    xcols, xrows = table([d[0] for d in cur.description], cur.fetchall())
    if cols != xcols:
        return False, f"columns {cols} != {xcols}"
    if len(rows) != len(xrows):
        return False, f"rows {len(rows)} != {len(xrows)}; e.g. {sorted(set(rows) ^ set(xrows), key=str)[:4]}"
    bad = [(a, b) for a, b in zip(rows, xrows) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(rows)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return True, f"{len(rows)} rows, {took:.1f}s"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connection(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            ok, note = compare(spark, con, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on to the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
