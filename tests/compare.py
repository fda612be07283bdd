"""Run registered queries against DuckDB on the same parquet files: python tests/compare.py [name ...]"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return v
    return str(v)


def canon(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, run, sql, sf_dir):
    t = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    ts = time.time() - t
    names, got = canon(df.columns, rows)
    if sql is None:
        return True, f"{len(rows)} rows {ts:.1f}s (no SQL)"
    t = time.time()
    cur = con.execute(sql)
    onames, want = canon([d[0] for d in cur.description], cur.fetchall())
    td = time.time() - t
    if names != onames:
        return False, f"columns {names} != {onames}"
    if got == want:
        return True, f"{len(rows)} rows {ts:.1f}s duck {td:.1f}s"
    g, w = set(got), set(want)
    return False, (f"rows {len(got)} vs {len(want)}; {names}\n   only spark {sorted(g - w, key=str)[:3]}\n"
                   f"   only duck  {sorted(w - g, key=str)[:3]}")


if __name__ == "__main__":
    from faultline.catalog import QUERIES
    from faultline.session import local_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    pick = sys.argv[1:]
    spark, con, bad = local_session(), connect(sf), []
    spark.sparkContext.setLogLevel("OFF")
    for name, q in QUERIES.items():
        if pick and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) or p in q.ops for p in pick):
            continue
        try:
            ok, msg = compare(spark, con, name, q.run, q.sql, sf)
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "FAIL", name, msg, flush=True)
        if not ok:
            bad.append(name)
    print(len(bad), "failed", bad)
