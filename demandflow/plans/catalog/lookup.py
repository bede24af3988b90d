"""Tiered fallback lookups."""

from __future__ import annotations

from demandflow.functions.categorical import sentinel
from demandflow.functions.numeric import r6, round_doubles
from demandflow.operators.lookup import tier_counts, tiered_lookup
from demandflow.operators.metrics import r2_score
from demandflow.plans.common import obs, ref_of, tgt_of
from demandflow.plans.registry import R, register, with_obs
from demandflow.sources.observations import lookup_samples

SIX_TIERS = [["day", "geohash", "timestamp", "road"], ["day", "geohash", "timestamp"],
             ["geohash", "timestamp", "road"], ["geohash", "timestamp"], ["geohash"]]
FOUR_TIERS = [["geohash", "timestamp", "road"], ["geohash", "timestamp"], ["geohash"]]

# The mean from an exact sum: decimals added in any order, divided once (as the operator does)
_MEAN = "(cast(sum(cast(demand AS decimal(28, 9))) AS double) / count(demand))"

_SAMPLES = [
    "tr AS (SELECT *, coalesce(road_type, 'MISSING') AS road FROM obs WHERE idx % 5 <> 0)",
    "te AS (SELECT *, coalesce(road_type, 'MISSING') AS road FROM obs WHERE idx % 5 = 0)",
    f"l1 AS (SELECT day, geohash, timestamp, road, {_MEAN} AS m FROM tr GROUP BY day, geohash, timestamp, road)",
    f"l2 AS (SELECT day, geohash, timestamp, {_MEAN} AS m FROM tr GROUP BY day, geohash, timestamp)",
    f"l3 AS (SELECT geohash, timestamp, road, {_MEAN} AS m FROM tr GROUP BY geohash, timestamp, road)",
    f"l4 AS (SELECT geohash, timestamp, {_MEAN} AS m FROM tr GROUP BY geohash, timestamp)",
    f"l5 AS (SELECT geohash, {_MEAN} AS m FROM tr GROUP BY geohash)",
    f"gm AS (SELECT {_MEAN} AS g FROM tr)",
    """lk AS (SELECT te.idx, coalesce(l1.m, l2.m, l3.m, l4.m, l5.m, gm.g) AS pred,
       CASE WHEN l1.m IS NOT NULL THEN 1 WHEN l2.m IS NOT NULL THEN 2 WHEN l3.m IS NOT NULL THEN 3
            WHEN l4.m IS NOT NULL THEN 4 WHEN l5.m IS NOT NULL THEN 5 ELSE 6 END AS tier
FROM te LEFT JOIN l1 USING (day, geohash, timestamp, road) LEFT JOIN l2 USING (day, geohash, timestamp)
LEFT JOIN l3 USING (geohash, timestamp, road) LEFT JOIN l4 USING (geohash, timestamp)
LEFT JOIN l5 USING (geohash) CROSS JOIN gm)""",
]


def _six_tier(spark, sf):
    train, test = lookup_samples(obs(spark, sf))
    train = train.withColumn("road", sentinel("road_type"))
    test = test.withColumn("road", sentinel("road_type"))
    return tiered_lookup(train, test, SIX_TIERS, "demand", out="pred", tier_col="tier")


@register("tiered_lookup", with_obs(f"SELECT idx, {R('pred')} AS pred, tier FROM lk", *_SAMPLES))
def q_tiered_lookup(spark, sf):
    """Six-tier fallback (day,geo,time,road) -> (day,geo,time) -> (geo,time,road)
    -> (geo,time) -> geo -> global mean; returns prediction and tier."""
    return _six_tier(spark, sf).select("idx", r6("pred").alias("pred"), "tier")


@register("tier_counts", with_obs(f"""
SELECT tier, count(*) AS n_rows, {R('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM lk GROUP BY tier""",
                                  *_SAMPLES))
def q_tier_counts(spark, sf):
    """M6: tier usage counts and percent."""
    return round_doubles(tier_counts(_six_tier(spark, sf)))


@register("tiered_lookup_score", with_obs(f"""
SELECT count(*) AS n, {R('1 - sum((demand - p) * (demand - p)) / (var_pop(demand) * count(*))')} AS r2,
       {R('greatest(0.0, 100 * (1 - sum((demand - p) * (demand - p)) / (var_pop(demand) * count(*))))')} AS score
FROM (SELECT t.demand, coalesce(a.m, b.m, c.m, g.g) AS p
      FROM tg t
      LEFT JOIN (SELECT geohash, timestamp, road, {_MEAN} AS m FROM rf GROUP BY geohash, timestamp, road) a
        USING (geohash, timestamp, road)
      LEFT JOIN (SELECT geohash, timestamp, {_MEAN} AS m FROM rf GROUP BY geohash, timestamp) b
        USING (geohash, timestamp)
      LEFT JOIN (SELECT geohash, {_MEAN} AS m FROM rf GROUP BY geohash) c USING (geohash)
      CROSS JOIN (SELECT {_MEAN} AS g FROM rf) g) s""",
    "rf AS (SELECT *, coalesce(road_type, 'MISSING') AS road FROM obs WHERE day <= 20)",
    "tg AS (SELECT *, coalesce(road_type, 'MISSING') AS road FROM obs WHERE day > 20)"))
def q_tiered_lookup_score(spark, sf):
    """J4 + M1: four-tier lookup fit on the reference period, scored on the target period."""
    o = obs(spark, sf).withColumn("road", sentinel("road_type"))
    looked = tiered_lookup(ref_of(o), tgt_of(o), FOUR_TIERS, "demand", out="pred", tier_col=None)
    return round_doubles(r2_score(looked, "demand", "pred"))
