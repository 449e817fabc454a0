"""Compare every registered Spark query with its DuckDB oracle (rows, columns, values).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import os

import duckdb

EXACT = os.environ.get("EXACT") == "1"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if EXACT else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, names=None, verbose=True):
    """Run queries and oracle SQL; return names that differ."""
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.2f}s")
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            continue
        if sorted(scols) != sorted(dcols):
            bad.append(name)
            print(f"FAIL {name}: columns spark={scols} duck={dcols}")
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            bad.append(name)
            diff = [x for x in a if x not in set(b)][:3]
            diff2 = [x for x in b if x not in set(a)][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)}\n  spark-only {diff}\n  duck-only {diff2}")
        elif verbose:
            print(f"OK   {name}: {len(a)} rows {ts:.2f}s")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from tickframe.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", 8)
    bad = compare(spark, sf, names)
    print("BAD:", bad)
    sys.exit(1 if bad else 0)
