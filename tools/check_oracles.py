"""Run registered queries in Spark and their SQL oracles in DuckDB, compare rows, columns and values.

    python tools/check_oracles.py [--sf-dir /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from threadtox.plans import catalog  # noqa: E402
from threadtox.session import build_session  # noqa: E402
from threadtox.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--skip-heavy", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf_dir}/{t}.parquet')")
    names = a.names or list(catalog.queries())
    bad = 0
    for name in names:
        q = catalog.QUERIES[name]
        if a.skip_heavy and q.heavy:
            continue
        t0 = time.time()
        try:
            sdf = q.build(spark, a.sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # report and go on
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"rows  {name}: {len(srows)} rows, cols={scols} ({ts:.1f}s)")
            continue
        t1 = time.time()
        try:
            res = con.execute(q.sql)
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:
            print(f"FAIL  {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        td = time.time() - t1
        ok_cols = sorted(c.lower() for c in scols) == sorted(c.lower() for c in dcols)
        sr, dr = rows_of(scols, srows), rows_of(dcols, drows)
        if ok_cols and sr == dr:
            print(f"OK    {name}: {len(srows)} rows ({ts:.1f}s spark, {td:.2f}s duckdb)")
        else:
            bad += 1
            print(f"FAIL  {name}: spark {len(srows)} rows {scols} / duckdb {len(drows)} rows {dcols}")
            sset, dset = set(sr), set(dr)
            print("   only spark:", list(sset - dset)[:3])
            print("   only duckdb:", list(dset - sset)[:3])
    spark.stop()
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
