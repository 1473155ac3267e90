"""Compares every query with its check SQL: python tests/check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(str(r[i]) for i in order) for r in rows]
    return sorted(out)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = entry_module.queries()[name](spark, sf_dir)
    mine = canonical(df.columns, df.collect())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return len(mine) > 0, f"rows only: {len(mine)}"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = canonical(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(columns) ^ set(df.columns))}"
    if mine != theirs:
        diff = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
        return False, f"{len(mine)} rows against {len(theirs)}; {sorted(columns)}; first differences {diff}"
    return True, f"{len(mine)} rows"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry_module.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(f"{'ok  ' if ok else 'FAIL'} {name:36s} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
