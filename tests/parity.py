"""Spark-vs-DuckDB comparison of one registered query (like the driver's check).

Row count, column names and an order-insensitive multiset of normalised
rows must all be equal.  Usable from pytest and as a script:
``python -m tests.parity [sf_dir] [name ...]``.
"""
from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return int(v)
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> dict:
    t0 = time.time()
    df = query(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    sc, sr = _canon(s_cols, s_rows)
    dc, dr = _canon(d_cols, d_rows)
    diff = None
    if sr != dr:
        only_s = [r for r in sr if r not in dr][:3]
        only_d = [r for r in dr if r not in sr][:3]
        diff = {"spark_only": only_s, "duck_only": only_d}
    return {
        "name": name,
        "rows_spark": len(sr),
        "rows_duck": len(dr),
        "columns_ok": sc == dc,
        "columns": (sc, dc) if sc != dc else sc,
        "values_ok": sr == dr,
        "diff": diff,
        "spark_sec": round(t1 - t0, 2),
    }


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from opslens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in sqls:
            print(f"{name}: no oracle")
            continue
        try:
            r = compare(spark, con, sf_dir, name, qs[name], sqls[name])
        except Exception as ex:  # report and continue
            bad += 1
            print(f"FAIL {name}: {type(ex).__name__}: {str(ex)[:400]}")
            continue
        ok = r["columns_ok"] and r["values_ok"] and r["rows_spark"] == r["rows_duck"]
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, r["rows_spark"], r["rows_duck"], r["spark_sec"],
              "" if ok else r)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
