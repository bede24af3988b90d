"""Developer check: run named queries against their DuckDB oracle.

usage: python tools_check.py [sf_dir] [name ...]
"""

import os
import sys
import time

from demandflow.plans import ORACLE, QUERIES
from demandflow.session import build_session
from tests.compare import compare, duck


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or sorted(QUERIES)
    spark = build_session("local[8]", 8)
    if os.environ.get("DEMANDFLOW_FORCE_BUCKETED"):
        # exercise the at-scale plans: bucketed positions, chunked windows, global numbering
        spark.conf.set("demandflow.order.smallDistinct", "10")
        spark.conf.set("demandflow.order.positionChunk", "97")
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLE:
                p = compare(df, con, ORACLE[n])
            else:
                df.count()
                p = ["(rows only)"]
        except Exception as e:  # noqa: BLE001
            p = [f"ERROR {type(e).__name__}: {str(e)[:600]}"]
        ok = not p or p == ["(rows only)"]
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:28s} {time.time() - t:6.2f}s {'' if ok else p}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
