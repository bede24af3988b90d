"""B1-B7, L6, IO2: blends over the three deterministic base predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.numeric import r6, round_doubles
from demandflow.operators import ensemble as ens
from demandflow.operators import metrics as mt
from demandflow.plans.catalog.order import RANK_SQL
from demandflow.plans.common import obs
from demandflow.plans.registry import BP_SQL, R, register, with_obs
from demandflow.sources import io
from demandflow.sources.observations import base_predictions

_MODELS = ["pa", "pb", "pc"]


@register("blend_equal", with_obs(f"SELECT idx, {R('(pa + pb + pc) / 3.0')} AS blend FROM bp", *BP_SQL))
def q_blend_equal(spark, sf):
    """B1: equal-weight average of three aligned predictions."""
    bp = base_predictions(obs(spark, sf))
    return ens.blend_equal(bp, _MODELS).select("idx", r6("blend").alias("blend"))


_GRID = [
    "lat AS (SELECT a.i0, b.i1, 20 - a.i0 - b.i1 AS i2 FROM (SELECT range AS i0 FROM range(21)) a, "
    "(SELECT range AS i1 FROM range(21)) b WHERE a.i0 + b.i1 <= 20)",
    "pts AS (SELECT i0, i1, i2, 1 - sum((demand - (i0 / 20.0 * pa + i1 / 20.0 * pb + i2 / 20.0 * pc)) * "
    "(demand - (i0 / 20.0 * pa + i1 / 20.0 * pb + i2 / 20.0 * pc))) / (var_pop(demand) * count(*)) AS r2 "
    "FROM lat CROSS JOIN bp GROUP BY i0, i1, i2)",
    "best AS (SELECT i0 / 20.0 AS w0, i1 / 20.0 AS w1, i2 / 20.0 AS w2 FROM pts ORDER BY r2 DESC, i0, i1, i2 LIMIT 1)",
]


@register("blend_grid", with_obs(f"""
SELECT {R('i0 / 20.0')} AS w_pa, {R('i1 / 20.0')} AS w_pb, {R('i2 / 20.0')} AS w_pc, {R('r2')} AS r2,
       {R('greatest(0.0, 100 * r2)')} AS score,
       cast(row_number() OVER (ORDER BY r2 DESC, i0, i1, i2) = 1 AS int) AS is_best
FROM pts""", *BP_SQL, *_GRID))
def q_blend_grid(spark, sf):
    """B2: 21-step simplex lattice scored from one moments aggregate (the oracle
    rescans every row per weight vector)."""
    bp = base_predictions(obs(spark, sf))
    return round_doubles(ens.blend_grid(bp, "demand", _MODELS, steps=21))


_RB = [
    "rk AS (SELECT idx, (" + " + ".join(f"{RANK_SQL.format(c=c)} / count(*) OVER ()" for c in _MODELS)
    + ") / 3.0 AS r FROM bp)",
    "sy AS (SELECT demand AS y, row_number() OVER (ORDER BY demand) - 1 AS j FROM bp)",
    "nn AS (SELECT count(*) AS n FROM bp)",
    "qm AS (SELECT rk.idx, r * (n - 1) AS p, cast(floor(r * (n - 1)) AS bigint) AS j0, n FROM rk CROSS JOIN nn)",
]


@register("blend_rank", with_obs(f"""
SELECT qm.idx, {R('CASE WHEN p = j0 THEN a.y ELSE a.y + (p - j0) * (b.y - a.y) END')} AS rank_blend
FROM qm JOIN sy a ON a.j = qm.j0 JOIN sy b ON b.j = least(qm.j0 + 1, qm.n - 1)""", *BP_SQL, *_RB))
def q_blend_rank(spark, sf):
    """Mean scaled rank of the three predictions mapped onto the sorted target."""
    bp = base_predictions(obs(spark, sf), materialize=True)
    out = ens.blend_rank(bp, _MODELS, "idx", bp, "demand", "rank_blend")
    return out.select("idx", r6("rank_blend").alias("rank_blend"))


@register("blend_apply", with_obs(f"SELECT idx, {R('w0 * pa + w1 * pb + w2 * pc')} AS blend FROM bp CROSS JOIN best",
                                  *BP_SQL, *_GRID))
def q_blend_apply(spark, sf):
    """Stored weights (the grid optimum, one row per model) applied to long predictions."""
    bp = base_predictions(obs(spark, sf), materialize=True)
    grid = ens.blend_grid(bp, "demand", _MODELS, steps=21).where(F.col("is_best") == 1)
    weights = grid.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"w_{m}").alias("weight"))
                                               for m in _MODELS])).alias("x")).select("x.*")
    long = ens.to_long(bp.select("idx", *_MODELS), "idx", _MODELS)
    return ens.blend_apply(long, weights).select("idx", r6("blend").alias("blend"))


_SOFT = [
    "st AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS study, 100 * (1 - sum((demand - {m}) * (demand - {m})) / (var_pop(demand) * count(*))) "
        f"AS best_score FROM bp" for m in _MODELS) + ")",
    "se AS (SELECT study, best_score, exp(best_score - max(best_score) OVER ()) AS e FROM st)",
    "ss AS (SELECT study, best_score, e / sum(e) OVER () AS share FROM se)",
]


@register("softmax_allocation", with_obs(f"""
SELECT study, {R('best_score')} AS best_score, {R('share')} AS share, cast(floor(180 * share) AS int) AS trials
FROM ss""", *BP_SQL, *_SOFT))
def q_softmax_allocation(spark, sf):
    """Split a budget of 180 extra trials by softmax of each study's best (raw) score."""
    bp = base_predictions(obs(spark, sf))
    s = bp.agg(*[(F.lit(100.0) * mt.r2_expr("demand", m)).alias(m) for m in _MODELS])
    long = s.select(F.explode(F.array(*[F.struct(F.lit(m).alias("study"), F.col(m).alias("best_score"))
                                        for m in _MODELS])).alias("x")).select("x.*")
    return round_doubles(ens.softmax_allocation(long, "best_score", 180))


@register("align_predictions", with_obs(f"SELECT idx, {R('pa')} AS pa, {R('pb')} AS pb, {R('pc')} AS pc FROM bp",
                                        *BP_SQL))
def q_align_predictions(spark, sf):
    """IO2 + J9: k models' prediction files (one header CSV each), read with a schema and lined up by row id."""
    bp = base_predictions(obs(spark, sf), materialize=True)
    paths = {m: io.write_table(bp.select("idx", F.col(m).alias("pred")), io.scratch_path(spark, f"pred-{m}"), "csv") for m in _MODELS}
    long = None
    for m, path in paths.items():
        one = spark.read.schema("idx long, pred double").option("header", True).csv(path).withColumn("model", F.lit(m))
        long = one if long is None else long.unionByName(one)
    return round_doubles(ens.align(long, "idx", _MODELS))


_OLS = ["one", "pa", "pb", "pc", "demand"]


def _ols_sql():
    e = {n: ("1.0" if n == "one" else n) for n in _OLS}
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, {R(f'sum({e[a]} * {e[b]})')} AS value FROM bp"
             for i, a in enumerate(_OLS) for b in _OLS[i:]]
    return " UNION ALL ".join(parts)


@register("ols_moments", with_obs(_ols_sql(), *BP_SQL))
def q_ols_moments(spark, sf):
    """L7 (SQL-checked part): X'X and X'y moments of demand ~ 1 + pa + pb + pc in one aggregate."""
    from demandflow.operators.models import ols_moments
    bp = base_predictions(obs(spark, sf))
    return round_doubles(ols_moments(bp, ["pa", "pb", "pc"], "demand"))


_BP5 = [
    "rq AS (SELECT *, coalesce(road_type, 'MISSING') AS road, coalesce(weather, 'MISSING') AS wkey FROM rf)",
    """bp5 AS (SELECT bp.*, coalesce(l3.m, l4.m, l5.m, ga.g) AS pd, coalesce(w.m, ga.g) AS pe
     FROM bp JOIN (SELECT *, coalesce(road_type, 'MISSING') AS road, coalesce(weather, 'MISSING') AS wkey FROM tg) t
       ON bp.idx = t.idx
     LEFT JOIN (SELECT geohash, timestamp, road, avg(demand) AS m FROM rq GROUP BY 1, 2, 3) l3
       ON t.geohash = l3.geohash AND t.timestamp = l3.timestamp AND t.road = l3.road
     LEFT JOIN (SELECT geohash, timestamp, avg(demand) AS m FROM rq GROUP BY 1, 2) l4
       ON t.geohash = l4.geohash AND t.timestamp = l4.timestamp
     LEFT JOIN (SELECT geohash, avg(demand) AS m FROM rq GROUP BY 1) l5 ON t.geohash = l5.geohash
     LEFT JOIN (SELECT wkey, hour, avg(demand) AS m FROM rq GROUP BY 1, 2) w ON t.wkey = w.wkey AND t.hour = w.hour
     CROSS JOIN ga)""",
    "lat5 AS (SELECT a.range AS i0, b.range AS i1, c.range AS i2, d.range AS i3, "
    "10 - a.range - b.range - c.range - d.range AS i4 FROM range(11) a, range(11) b, range(11) c, range(11) d "
    "WHERE a.range + b.range + c.range + d.range <= 10)",
    "pts5 AS (SELECT i0, i1, i2, i3, i4, 1 - sum(power(demand - (i0 * pa + i1 * pb + i2 * pc + i3 * pd + i4 * pe) / 10.0, 2))"
    " / (var_pop(demand) * count(*)) AS r2 FROM lat5 CROSS JOIN bp5 GROUP BY i0, i1, i2, i3, i4)",
]
_M5 = ["pa", "pb", "pc", "pd", "pe"]


def base_predictions_5(spark, sf):
    """The three base predictions plus ``pd`` (four-tier lookup fit on the reference
    period) and ``pe`` (mean by weather-or-MISSING x hour), aligned on ``idx``."""
    from demandflow.functions.categorical import sentinel
    from demandflow.functions.time import hour_of
    from demandflow.operators.encoders import apply_mean, fit_mean
    from demandflow.operators.lookup import tiered_lookup
    from demandflow.plans.catalog.lookup import FOUR_TIERS
    from demandflow.session import materialize
    o = obs(spark, sf).withColumns({"road": sentinel("road_type"), "wkey": sentinel("weather"),
                                    "hour": hour_of("timestamp")})
    ref, tgt = o.where(F.col("day") <= 20), o.where(F.col("day") > 20)
    pd_ = tiered_lookup(ref, tgt, FOUR_TIERS, "demand", out="pd", tier_col=None)
    pe_ = apply_mean(pd_, fit_mean(ref, ["wkey", "hour"], "demand"), ["wkey", "hour"], "pe")
    bp = base_predictions(obs(spark, sf))
    return materialize(bp.join(pe_.select("idx", "pd", "pe"), "idx"), "base-predictions-5")


@register("blend_grid_5", with_obs(f"""
SELECT {R('i0 / 10.0')} AS w_pa, {R('i1 / 10.0')} AS w_pb, {R('i2 / 10.0')} AS w_pc, {R('i3 / 10.0')} AS w_pd,
       {R('i4 / 10.0')} AS w_pe, {R('r2')} AS r2, {R('greatest(0.0, 100 * r2)')} AS score,
       cast(row_number() OVER (ORDER BY r2 DESC, i0, i1, i2, i3, i4) = 1 AS int) AS is_best
FROM pts5""", *BP_SQL, *_BP5))
def q_blend_grid_5(spark, sf):
    """B2 with five models on the coarse 11-step lattice (1,001 weight vectors),
    every point scored from one 5 x 5 moments aggregate."""
    return round_doubles(ens.blend_grid(base_predictions_5(spark, sf), "demand", _M5, steps=11))
