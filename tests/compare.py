"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def check(spark, con, folder, query, oracle):
    """(spark rows, sql rows, names, seconds) in canonical form."""
    began = time.time()
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    middle = time.time()
    result = con.execute(oracle)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    done = time.time()
    return (
        rows_of(df.columns, got), rows_of(names, want), sorted(df.columns), sorted(names),
        round(middle - began, 2), round(done - middle, 2),
    )


def main():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from skeinwork.session import local_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    wanted = sys.argv[1:] or list(entry.queries())
    for name in wanted:
        query = entry.queries()[name]
        try:
            if name not in oracles:
                began = time.time()
                print(f"{name:28s} rows only {query(spark, folder).count()} {time.time() - began:.1f}s", flush=True)
                continue
            got, want, cols, sql_cols, took, sql_took = check(spark, con, folder, query, oracles[name])
        except Exception as error:
            print(f"{name:28s} ERROR {type(error).__name__} {str(error)[:1500]}", flush=True)
            continue
        same = got == want and cols == sql_cols
        print(f"{name:28s} {'ok' if same else 'DIFF'} rows {len(got)}/{len(want)} {took}s sql {sql_took}s", flush=True)
        if not same:
            print("   ", cols, sql_cols)
            a, b = set(got) - set(want), set(want) - set(got)
            print("    spark only", len(a), [str(x)[:300] for x in list(a)[:3]])
            print("    sql only  ", len(b), [str(x)[:300] for x in list(b)[:3]])


if __name__ == "__main__":
    main()
