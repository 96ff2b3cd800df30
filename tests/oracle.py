"""Side-by-side runner: each registered query against its DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

_DUCK = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp"}


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    """Return (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(rows)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    desc = {d[0]: str(d[1]) for d in cur.description}
    dcols = sorted(desc)
    order = [d[0] for d in cur.description]
    want = []
    for r in cur.fetchall():
        m = dict(zip(order, r))
        want.append(tuple(_norm(m[c]) for c in dcols))
    t2 = time.time()
    if cols != dcols:
        return False, f"columns differ: spark {cols} oracle {dcols}"
    types = dict(df.dtypes)
    bad = [(c, types[c], desc[c]) for c in cols if _DUCK.get(desc[c], desc[c]) != types[c]]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(rows, key=key), sorted(want, key=key)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return False, (f"rows spark {len(a)} oracle {len(b)}; cols {cols}; only spark {sorted(sa - sb)[:3]} "
                       f"only oracle {sorted(sb - sa)[:3]}")
    if bad:
        return False, f"types differ: {bad}"
    if not a:
        return False, "no rows on either side"
    return True, f"{len(a)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.2f}s"


if __name__ == "__main__":
    sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))
    import traceback

    from fieldbook.catalog import load_all
    from fieldbook.session import local_session

    sf = sys.argv[1]
    pat = sys.argv[2:]
    queries, oracles = load_all()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n, fn in queries.items():
        if pat and not any(n.startswith(p) for p in pat):
            continue
        try:
            ok, msg = compare(spark, con, n, fn, oracles.get(n), sf)
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
            if "-v" in pat:
                traceback.print_exc()
        bad += not ok
        print(("ok  " if ok else "FAIL"), n, msg, flush=True)
    print("failures:", bad)
