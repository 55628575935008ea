"""Runs queries of the entry module against their SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings train docvectors relevance termdict evalitems".split()


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (repr(v + 0.0) if math.isinf(v) else f"{v:.5f}")
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, name: str, folder: str) -> str:
    t = time.time()
    df = entry.queries()[name](spark, folder)
    mine = rows_of(df.columns, df.collect())
    took = time.time() - t
    if name not in entry.oracle_sql():
        return f"rows {len(mine)} ({took:.1f} s, no SQL)"
    t = time.time()
    r = connection.sql(entry.oracle_sql()[name])
    theirs = rows_of(r.columns, r.fetchall())
    sql = time.time() - t
    if sorted(df.columns) != sorted(r.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(r.columns)}"
    if mine == theirs:
        return f"ok {len(mine)} ({took:.1f} s, SQL {sql:.1f} s)"
    a, b = set(mine), set(theirs)
    return f"DIFFERENT {len(mine)} {len(theirs)}: only ours {sorted(a - b)[:4]}, only SQL {sorted(b - a)[:4]} ({took:.1f} s)"


if __name__ == "__main__":
    folder = sys.argv[1]
    names = [n for n in entry.queries() if not sys.argv[2:] or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in sys.argv[2:])]
    spark, connection = session(), duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        try:
            print(name, compare(spark, connection, name, folder), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", str(e)[:900], flush=True)
