"""Command line check: python tests/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.compare import connect, diff, oracle_rows, spark_rows  # noqa: E402


def main() -> None:
    from tessera.plans import catalog
    from tessera.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    want = sys.argv[2:]
    path = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(path)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            a = spark_rows(fn(spark, path))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark: {str(e)[:700]}", flush=True)
            continue
        t1 = time.time() - t
        if name not in catalog.ORACLES:
            print(f"rows  {name}: {len(a[1])} rows, {t1:.1f}s; first {a[1][:1]}", flush=True)
            continue
        try:
            t = time.time()
            b = oracle_rows(con, catalog.ORACLES[name])
            t2 = time.time() - t
            d = diff(a, b)
        except Exception as e:  # noqa: BLE001
            d, t2 = f"oracle: {str(e)[:700]}", 0
        bad += d is not None
        nulls = sum(v is None for r in a[1] for v in r)
        cells = max(1, sum(len(r) for r in a[1]))
        print(f"{'FAIL' if d else 'ok  '}  {name}: {len(a[1])} rows, null {nulls / cells:.0%}, {t1:.1f}s / {t2:.1f}s {d or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
