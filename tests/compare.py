"""Run registered queries on Spark and on DuckDB and compare the answers."""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import threading
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cores}]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


LIMIT = 60  # seconds for each side of one query

# Result types that mean the same on both sides.
SAME_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
              "boolean": "BOOLEAN"}


def oracle_rows(con, sql: str):
    rel = con.sql(sql)
    return rel.columns, [str(t) for t in rel.types], rel.fetchall()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    guard = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    guard.start()
    frame = fn(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    guard.cancel()
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(got)} {took:.1f}s (no oracle)"
    guard = threading.Timer(LIMIT, con.interrupt)
    guard.start()
    start = time.time()
    cols, types, want = oracle_rows(con, sql)
    guard.cancel()
    took_sql = time.time() - start
    if sorted(cols) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(cols)}"
    mismatch = [(c, t, dict(zip(cols, types))[c]) for c, t in frame.dtypes
                if SAME_TYPES.get(t, t) != dict(zip(cols, types))[c]]
    a, b = rows_of(frame.columns, got), rows_of(list(cols), want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a, only_b = [r for r in a if r not in in_b][:3], [r for r in b if r not in in_a][:3]
        return False, (f"rows {len(a)} vs {len(b)}; columns {sorted(cols)}\n"
                       f"   spark only {only_a}\n   oracle only {only_b}")
    note = f" TYPES {mismatch}" if mismatch else ""
    if not a:
        note += " EMPTY"
    return True, f"rows={len(a)} {took:.1f}s sql {took_sql:.1f}s{note}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--section", action="append")
    parser.add_argument("--budget", type=float, default=1e9)
    args = parser.parse_args()
    import importlib

    import catalog

    if args.section:
        for s in args.section:
            importlib.import_module(f"catalog.{s}")
    else:
        catalog.load_all()
    spark, con = session(), connect(args.sf)
    bad, begun = 0, time.time()
    for name, fn in catalog.QUERIES.items():
        if args.names and name not in args.names:
            continue
        try:
            ok, note = check(spark, con, name, fn, catalog.ORACLES.get(name), args.sf)
        except Exception as e:  # noqa: BLE001
            ok, note = False, "".join(traceback.format_exception_only(e))[:1500]
            if args.names:
                traceback.print_exc()
        bad += not ok
        if time.time() - begun > args.budget:
            print("budget used up before", name)
            break
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
