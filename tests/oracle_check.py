"""Run every registered query in Spark and its SQL text in DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]

Compares row count, column names and an order-insensitive hash of the
values (columns sorted by name), like the round driver does.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STRICT = os.environ.get("STRICT") == "1"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if STRICT else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {str(k): _norm(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from tradewind.session import build_session
    spark = build_session(os.environ.get("MASTER", "local[8]"), shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in (keys or list(qs)):
        t0 = time.time()
        try:
            df = qs[k](spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            t_spark = time.time() - t0
        except Exception as e:  # report and go on
            results[k] = {"status": "spark_error", "error": str(e)[:400]}
            print(k, "SPARK ERROR", str(e)[:400], flush=True)
            continue
        if k not in sqls:
            results[k] = {"status": "rows_only", "rows": len(rows), "sec": round(t_spark, 2)}
            print(f"{k:28s} rows-only rows={len(rows)} {t_spark:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[k])
            dcols = [c[0] for c in cur.description]
            drows = cur.fetchall()
        except Exception as e:
            results[k] = {"status": "sql_error", "error": str(e)[:400]}
            print(k, "SQL ERROR", str(e)[:400], flush=True)
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(dcols, drows)
        ok = (len(rows) == len(drows) and sorted(cols) == sorted(dcols) and h1 == h2)
        results[k] = {"status": "match" if ok else "mismatch", "rows": len(rows),
                      "oracle_rows": len(drows), "sec": round(t_spark, 2)}
        print(f"{k:28s} {'OK ' if ok else 'BAD'} rows={len(rows)}/{len(drows)} {t_spark:.1f}s", flush=True)
        if not ok:
            if sorted(cols) != sorted(dcols):
                print("   cols spark:", cols, "\n   cols duck: ", dcols)
            a, b = set(l1), set(l2)
            for x in list(a - b)[:3]:
                print("   spark only:", x[:300])
            for x in list(b - a)[:3]:
                print("   duck only: ", x[:300])
    n_ok = sum(1 for v in results.values() if v["status"] in ("match",))
    print(json.dumps({"match": n_ok, "total": len(results)}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
