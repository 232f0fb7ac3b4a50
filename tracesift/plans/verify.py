"""Run every registered query against its DuckDB twin (row count, schema, order-free value hash).

    python -m tracesift.plans.verify [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


STRICT = False


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0 if STRICT else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    canon = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(canon).encode()).hexdigest(), canon


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True):
    from . import catalog  # noqa: F401  (registers queries)
    from .registry import QUERIES

    con = duck(sf_dir)
    results = {}
    for name, q in QUERIES.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.build(spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:400])
            if verbose:
                print(f"{name:32s} SPARK_ERROR {repr(e)[:300]}", flush=True)
            continue
        ts = time.time() - t0
        if q.sql is None:
            results[name] = ("ROWS_ONLY", len(rows))
            if verbose:
                print(f"{name:32s} rows-only  n={len(rows)}  {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(q.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", repr(e)[:400])
            if verbose:
                print(f"{name:32s} SQL_ERROR {repr(e)[:300]}", flush=True)
            continue
        ok_cols = sorted(c.lower() for c in cols) == sorted(c.lower() for c in dcols)
        h1, c1 = digest(cols, rows)
        h2, c2 = digest(dcols, drows)
        status = "OK" if (ok_cols and h1 == h2 and len(rows) == len(drows)) else "MISMATCH"
        results[name] = (status, len(rows), len(drows))
        if verbose:
            print(f"{name:32s} {status:8s} spark={len(rows)} duck={len(drows)} cols_ok={ok_cols} {ts:.1f}s", flush=True)
            if status != "OK":
                if not ok_cols:
                    print("   spark cols", cols, "\n   duck cols ", dcols)
                s1, s2 = set(c1), set(c2)
                for x in list(s1 - s2)[:3]:
                    print("   only spark:", x[:300])
                for x in list(s2 - s1)[:3]:
                    print("   only duck: ", x[:300])
    return results


def main(argv=None):
    global STRICT
    argv = list(sys.argv[1:] if argv is None else argv)
    if "--strict" in argv:
        STRICT = True
        argv.remove("--strict")
    sf_dir = argv.pop(0) if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    from ..session import get_session

    spark = get_session()
    res = compare(spark, sf_dir, set(argv) or None)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "ROWS_ONLY")}
    print(f"{len(res) - len(bad)}/{len(res)} ok; failing: {sorted(bad)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
