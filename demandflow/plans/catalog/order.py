"""Distributed ranks, quantile bins and quantile mapping."""

from __future__ import annotations

from demandflow.functions.numeric import r6
from demandflow.operators.order import average_rank, quantile_bins, quantile_map
from demandflow.plans.common import obs
from demandflow.plans.registry import BP_SQL, R, register, with_obs
from demandflow.sources.observations import base_predictions

_PROBS = ", ".join(repr(i / 10) for i in range(11))
QBIN_SQL = (f"qb AS (SELECT o.*, cast(len(list_filter(edges[2:len(edges) - 1], lambda x: o.demand > x)) AS int) AS bin "
            f"FROM obs o CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(demand, [{_PROBS}]))) AS edges "
            f"FROM obs) e)")
RANK_SQL = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@register("avg_rank", with_obs(f"SELECT idx, {R(RANK_SQL.format(c='pa'))} AS rank_pa, "
                               f"{R(RANK_SQL.format(c='pb') + ' / count(*) OVER ()')} AS scaled_rank_pb FROM bp",
                               *BP_SQL))
def q_avg_rank(spark, sf):
    """Average-tie ranks (raw, and scaled by n) without a single-task window."""
    bp = base_predictions(obs(spark, sf), materialize=True)
    a = average_rank(bp.select("idx", "pa"), "pa", "rank_pa")
    b = average_rank(bp.select("idx", "pb"), "pb", "scaled_rank_pb", scaled=True)
    return a.join(b, "idx").select("idx", r6("rank_pa").alias("rank_pa"), r6("scaled_rank_pb").alias("scaled_rank_pb"))


@register("quantile_bins", with_obs("SELECT idx, bin FROM qb", QBIN_SQL))
def q_quantile_bins(spark, sf):
    """``qcut(demand, 10, duplicates='drop')`` with exact edges."""
    return quantile_bins(obs(spark, sf), "demand", 10, "bin").select("idx", "bin")


QMAP_SQL = [
    f"rr AS (SELECT idx, {RANK_SQL.format(c='pa')} / count(*) OVER () AS r FROM bp)",
    "sy AS (SELECT demand AS y, row_number() OVER (ORDER BY demand) - 1 AS j FROM bp)",
    "nn AS (SELECT count(*) AS n FROM bp)",
    """qm AS (SELECT rr.idx, r * (n - 1) AS p, cast(floor(r * (n - 1)) AS bigint) AS j0, n FROM rr CROSS JOIN nn)""",
]


@register("quantile_map", with_obs(f"""
SELECT qm.idx, {R('CASE WHEN p = j0 THEN a.y ELSE a.y + (p - j0) * (b.y - a.y) END')} AS mapped
FROM qm JOIN sy a ON a.j = qm.j0 JOIN sy b ON b.j = least(qm.j0 + 1, qm.n - 1)""", *BP_SQL, *QMAP_SQL))
def q_quantile_map(spark, sf):
    """Map the scaled rank of ``pa`` onto the sorted target sample (np.interp)."""
    bp = base_predictions(obs(spark, sf), materialize=True)
    r = average_rank(bp.select("idx", "pa"), "pa", "r", scaled=True).select("idx", "r")
    return quantile_map(r, "r", bp, "demand", "mapped").select("idx", r6("mapped").alias("mapped"))
