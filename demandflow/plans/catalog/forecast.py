"""T1-T6 forecasting queries and the W1 rolling profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.numeric import r6, round_doubles
from demandflow.operators import forecast as fc
from demandflow.operators.metrics import r2_score
from demandflow.operators.order import rolling_mean
from demandflow.plans.common import obs_t, ref_of, tgt_of
from demandflow.plans.registry import R, register, with_obs


def _clip(x, lo, hi):
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END)"


_TS = [
    "rf AS (SELECT * FROM obs_t WHERE day <= 20)",
    "tg AS (SELECT * FROM obs_t WHERE day > 20)",
    "ex AS (SELECT geohash, slot, avg(demand) AS lag FROM rf GROUP BY geohash, slot)",
    """rl AS (SELECT geohash, slot, avg(r) AS roll FROM (
       SELECT geohash, slot, avg(demand) OVER (PARTITION BY geohash ORDER BY slot, idx
                                               ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM rf) x
     GROUP BY geohash, slot)""",
    """tpl AS (SELECT coalesce(ex.geohash, rl.geohash) AS geohash, coalesce(ex.slot, rl.slot) AS slot, lag, roll
     FROM ex FULL JOIN rl ON ex.geohash = rl.geohash AND ex.slot = rl.slot)""",
    "rd AS (SELECT coalesce(road_type, 'MISSING') AS road, slot, avg(demand) AS road_d FROM rf GROUP BY 1, 2)",
    "e48 AS (SELECT geohash, avg(demand) AS m FROM rf WHERE slot <= 8 GROUP BY geohash)",
    "e49 AS (SELECT geohash, avg(demand) AS m FROM tg WHERE slot <= 8 GROUP BY geohash)",
    """tr0 AS (SELECT e48.geohash, e48.m AS m48, e49.m AS m49, e49.m / nullif(e48.m, 0) AS ratio
     FROM e48 LEFT JOIN e49 ON e48.geohash = e49.geohash)""",
    "gr AS (SELECT quantile_cont(ratio, 0.5) AS g FROM tr0)",
    f"""tr AS (SELECT geohash, m48, m49, {_clip('coalesce(ratio, g)', 0.1, 10.0)} AS mult,
       coalesce(m49 - m48, 0.0) AS off FROM tr0 CROSS JOIN gr)""",
    """feat AS (SELECT t.idx, t.slot, t.number_of_lanes, t.demand,
       coalesce(tpl.lag, rd.road_d) AS lag, coalesce(tpl.roll, rd.road_d) AS roll, rd.road_d,
       coalesce(tr.mult, gr.g) AS mult, coalesce(tr.off, 0.0) AS off,
       coalesce(tpl.roll, rd.road_d) * coalesce(tr.mult, gr.g) AS heur
     FROM tg t LEFT JOIN tpl ON t.geohash = tpl.geohash AND t.slot = tpl.slot
     LEFT JOIN rd ON rd.road = coalesce(t.road_type, 'MISSING') AND rd.slot = t.slot
     LEFT JOIN tr ON t.geohash = tr.geohash CROSS JOIN gr)""",
]


def _tpl(spark, sf):
    o = obs_t(spark, sf)
    ref, tgt = ref_of(o), tgt_of(o)
    return tgt, fc.fit_templates(ref, tgt)


@register("ts_templates", with_obs(f"SELECT geohash, slot, {R('lag')} AS d48_lag_demand, "
                                   f"{R('roll')} AS d48_rolling_mean FROM tpl", *_TS))
def q_ts_templates(spark, sf):
    """T1 + T3 + J6: exact and rolling templates, full outer join."""
    return round_doubles(fc.templates_joined(ref_of(obs_t(spark, sf))))


@register("ts_road_template", with_obs(f"SELECT road, slot, {R('road_d')} AS d48_road_demand FROM rd", *_TS))
def q_ts_road_template(spark, sf):
    """Road template (null road -> MISSING)."""
    return round_doubles(fc.template_road(ref_of(obs_t(spark, sf))))


@register("ts_trend", with_obs(f"""
SELECT geohash, {R('m48')} AS early_d48_mean, {R('m49')} AS early_d49_mean, {R('mult')} AS trend_multiplier,
       {R('off')} AS trend_offset FROM tr""", *_TS))
def q_ts_trend(spark, sf):
    """T4 + J7: early-slot trend per geohash with the median global ratio."""
    o = obs_t(spark, sf)
    t, _ = fc.trend(ref_of(o), tgt_of(o))
    return round_doubles(t)


@register("rolling_profile", with_obs(f"""
SELECT idx, {R('avg(demand) OVER (PARTITION BY geohash ORDER BY slot, idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')}
  AS rolling_mean FROM rf""", *_TS))
def q_rolling_profile(spark, sf):
    """Centred 5-row rolling mean per geohash ordered by (slot, idx).  When the
    largest geohash exceeds 512 rows the rows are split into row-number chunks
    with halo rows (otherwise one window per geohash)."""
    ref = ref_of(obs_t(spark, sf)).select("idx", "geohash", "slot", "demand")
    out = rolling_mean(ref, "demand", ["geohash"], ["slot", "idx"], 2, "rolling_mean", chunk_rows=512)
    return out.select("idx", r6("rolling_mean").alias("rolling_mean"))


@register("ts_features", with_obs(f"""
SELECT idx, slot AS time_idx, number_of_lanes, {R('lag')} AS d48_lag_demand, {R('roll')} AS d48_rolling_mean,
       {R('road_d')} AS d48_road_demand, {R('mult')} AS trend_multiplier, {R('off')} AS trend_offset,
       {R('heur')} AS heuristic_demand, cast(slot <= 5 AS int) AS is_fit_slot
FROM feat""", *_TS))
def q_ts_features(spark, sf):
    """T5 + V5: feature assembly with fallbacks for the target period, plus the
    early-slot fit/check split flag (slot <= 5 fit, later slots check)."""
    tgt, tpl = _tpl(spark, sf)
    f = fc.ts_features(tgt, tpl)
    f = f.select("idx", F.col("slot").alias("time_idx"), "number_of_lanes", "d48_lag_demand", "d48_rolling_mean",
                 "d48_road_demand", "trend_multiplier", "trend_offset", "heuristic_demand",
                 (F.col("slot") <= 5).cast("int").alias("is_fit_slot"))
    return round_doubles(f)


@register("ts_heuristic", with_obs(f"SELECT idx, {R('heur')} AS heuristic_demand FROM feat", *_TS))
def q_ts_heuristic(spark, sf):
    """Heuristic forecast = rolling template x trend multiplier, per target row."""
    tgt, tpl = _tpl(spark, sf)
    return fc.ts_features(tgt, tpl).select("idx", r6("heuristic_demand").alias("heuristic_demand"))


@register("ts_heuristic_score", with_obs(f"""
SELECT count(heur) AS n, count(*) - count(heur) AS n_null,
  {R('1 - sum((demand - heur) * (demand - heur)) / (var_pop(CASE WHEN heur IS NOT NULL THEN demand END) * count(heur))')} AS r2,
  {R('greatest(0.0, 100 * (1 - sum((demand - heur) * (demand - heur)) / (var_pop(CASE WHEN heur IS NOT NULL THEN demand END) * count(heur))))')} AS score
FROM feat WHERE slot > 5""", *_TS))
def q_ts_heuristic_score(spark, sf):
    """T6 + M1: heuristic scored on the check slots (> 5) of the target period;
    rows whose heuristic is null are counted, not scored."""
    tgt, tpl = _tpl(spark, sf)
    f = fc.ts_features(tgt, tpl).where(F.col("slot") > 5)
    s = r2_score(f, "demand", "heuristic_demand")
    nulls = f.agg(F.count(F.when(F.col("heuristic_demand").isNull(), 1)).alias("n_null"))
    return round_doubles(s.crossJoin(nulls).select("n", "n_null", "r2", "score"))
