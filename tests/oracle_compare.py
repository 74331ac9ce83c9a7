"""Side-by-side check of a catalogue query against its DuckDB oracle SQL.

Mirrors the driver's gate: same row count, same column names, same order-insensitive multiset of
rows (floats compared after rounding).  Usable from pytest and as a script:

    python tests/oracle_compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(_norm(v) for v in r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    o_cols = [d[0] for d in rel.description]
    o_rows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    problems = []
    if sorted(s_cols) != sorted(o_cols):
        problems.append(f"columns spark={s_cols} oracle={o_cols}")
    else:
        order = [o_cols.index(c) for c in s_cols]
        o_rows = [tuple(r[i] for i in order) for r in o_rows]
    if len(s_rows) != len(o_rows):
        problems.append(f"rows spark={len(s_rows)} oracle={len(o_rows)}")
    elif not problems:
        a = sorted(s_rows, key=_key)
        b = sorted(o_rows, key=_key)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            problems.append(f"{len(diff)} rows differ, e.g. spark={diff[0][0]} oracle={diff[0][1]}")
    return problems, len(s_rows), t1 - t0


def main(argv):
    from postlens.session import get_session
    import __spark_entry__ as entry

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = get_session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROWS  {name:32s} rows={n} ({time.time() - t0:.1f}s)")
            continue
        try:
            problems, n, secs = compare(spark, con, name, fn, sqls[name], sf_dir)
        except Exception as e:  # report and continue
            problems, n, secs = [f"error {type(e).__name__}: {str(e)[:400]}"], -1, 0
        status = "OK   " if not problems else "FAIL "
        bad += bool(problems)
        print(f"{status} {name:32s} rows={n} ({secs:.1f}s) {'; '.join(problems)}")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
