"""Run registered queries on Spark and their SQL on DuckDB; compare results.

usage: python scripts/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

import duckdb  # noqa: E402

from basketry import registry  # noqa: E402
from basketry.session import local_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        return tuple(v.tolist())
    if isinstance(v, list):
        return tuple(v)
    return v


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = registry.QUERIES[name](spark, sf_dir)
            rows = [tuple(norm(x) for x in r) for r in sdf.collect()]
            cols = sdf.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        sql = registry.ORACLE.get(name)
        if sql is None:
            print(f"{name:40s} rows={len(rows):7d} spark={ts:6.2f}s (no oracle)")
            continue
        try:
            res = con.execute(sql)
            dcols = [d[0] for d in res.description]
            drows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:40s} SQL ERROR {str(e)[:300]}")
            bad += 1
            continue
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
        same_cols = sorted(cols) == sorted(dcols)
        a = sorted((tuple(r[i] for i in order) for r in rows), key=repr)
        b = sorted((tuple(r[i] for i in dorder) for r in drows), key=repr)
        ok = same_cols and a == b
        bad += not ok
        print(f"{name:40s} rows={len(rows):7d}/{len(drows):7d} cols={'ok' if same_cols else 'DIFF'}"
              f" values={'ok' if a == b else 'DIFF'} spark={ts:6.2f}s")
        if not ok:
            print("   spark cols", cols, "\n   duck cols ", dcols)
            diff_a = [r for r in a if r not in set(b)][:3]
            diff_b = [r for r in b if r not in set(a)][:3]
            print("   spark-only", diff_a, "\n   duck-only ", diff_b)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
