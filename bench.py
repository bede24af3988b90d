"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric": ..., "value": total_sec, "unit": "sec",
"queries": {name: sec}, "sf": ...}.  Every query is fully executed with the
``noop`` sink (all partitions computed, nothing collected to the driver).

usage: python bench.py [--all] [name ...]
(set BENCH_EVENT_LOG_DIR to a scratch folder to keep Spark's event log for stage times)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "te_smoothed", "te_period_fit", "tiered_lookup", "ts_heuristic", "ts_templates", "geo_stats",
    "describe_numeric", "top_values", "avg_rank", "quantile_bins", "stratified_folds", "rolling_folds",
    "blend_grid", "blend_rank", "roc_auc", "key_coverage", "label_encode", "leaderboard",
    "cv_oof", "permutation_importance",
]


def main() -> None:
    from demandflow.plans import QUERIES
    from demandflow.session import build_session

    args = sys.argv[1:]
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in args if not a.startswith("--")]
    if "--all" in args:
        names = sorted(QUERIES)
    names = names or HEADLINE
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "4g")}
    if os.environ.get("BENCH_EVENT_LOG_DIR"):  # stage/task times without the web UI
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG_DIR"]})
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra=extra)
    # JVM / codegen warm-up on the smallest fixture, not timed
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        QUERIES["te_smoothed"](spark, warm).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 -- report and continue
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
