"""Run registered Spark queries and their SQL oracle side by side (like the driver).

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return f"{name}: rows-only {len(srows)} rows ({t1 - t0:.1f}s)"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
    t2 = time.time()
    msgs = []
    if sorted(scols) != sorted(dcols):
        msgs.append(f"columns differ: spark-only {set(scols) - set(dcols)} sql-only {set(dcols) - set(scols)}")
        return f"{name}: FAIL " + "; ".join(msgs)
    idx = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in idx) for r in drows]
    if len(srows) != len(drows):
        msgs.append(f"rows spark={len(srows)} sql={len(drows)}")
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        msgs.append(f"{len(bad)} differing rows, first: spark={bad[0][0]} sql={bad[0][1]}")
    status = "ok" if not msgs else "FAIL " + "; ".join(msgs)
    return f"{name}: {status} ({len(srows)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s)"


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as E
    from fleetscope.session import get_spark
    spark = get_spark("local[8]", 8)
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    fails = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            msg = compare(spark, con, name, fn, ors.get(name), sf_dir)
        except Exception as e:  # report and continue
            msg = f"{name}: ERROR {type(e).__name__}: {str(e)[:400]}"
        fails += ("FAIL" in msg) or ("ERROR" in msg)
        print(msg, flush=True)
    print(f"done, {fails} failing")


if __name__ == "__main__":
    main()
