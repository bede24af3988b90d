"""Developer tool: summarise the executed physical plan of queries (after AQE).

usage: python tools_plans.py [sf_dir] [name ...]  -> markdown table on stdout
"""

import re
import sys

from demandflow.plans import QUERIES
from demandflow.session import build_session

HEADLINE = ["te_smoothed", "te_period_fit", "tiered_lookup", "ts_heuristic", "geo_stats", "describe_numeric",
            "top_values", "avg_rank", "quantile_bins", "stratified_folds", "blend_grid", "roc_auc",
            "key_coverage", "label_encode"]


def summarise(plan: str) -> dict:
    return {
        "exchanges": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
                                    plan)),
        "broadcast_joins": plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin"),
        "smj": plan.count("SortMergeJoin"),
        "reused": plan.count("ReusedExchange"),
        "window_group_limit": plan.count("WindowGroupLimit"),
        "scans": plan.count("Scan parquet"),
        "read_cols": sorted(set(c for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan)
                                for c in re.findall(r"(\w+):", s))),
    }


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    names = [a for a in args if not a.startswith("/")] or HEADLINE
    spark = build_session("local[8]", 16)
    print("| query | exchanges | broadcast joins | sort-merge joins | reused exchanges | group limit | parquet scans | columns read |")
    print("|---|---|---|---|---|---|---|---|")
    for n in names:
        df = QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        s = summarise(plan)
        print(f"| {n} | {s['exchanges']} | {s['broadcast_joins']} | {s['smj']} | {s['reused']} | "
              f"{s['window_group_limit']} | {s['scans']} | {', '.join(s['read_cols'])} |",
              flush=True)


if __name__ == "__main__":
    main()
