"""Feature blocks put to the test, and crosses chosen by the data."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.functions import geo
from demandflow.functions.categorical import category_cross
from demandflow.functions.numeric import interactions_ext, round_doubles
from demandflow.operators import encoders as enc
from demandflow.operators import features as feat
from demandflow.operators import models as md
from demandflow.operators.crosses import pair_gains
from demandflow.operators.fits import FitPlan
from demandflow.plans.catalog.models import CAT_FEATURES, FEATURES, GEO_FEATURES, TIME_FEATURES, _demand_of, model_frame, preset_fit
from demandflow.plans.common import obs_t, ref_of, tgt_of
from demandflow.plans.registry import R, register, with_obs
from demandflow.session import materialize

#: The columns that a block adds to the base features (all but the geohash's)
BASE = [f for f in FEATURES if f not in GEO_FEATURES]
BLOCKS = {
    "geo_mean": ["geo_mean_demand"],
    "geo_lanes": ["geo_lanes_mean", "geo_lanes_max"],
    "geo_temp": ["geo_temp_mean", "geo_temp_std"],
    "geo_weather": ["geo_weather_0", "geo_weather_1", "geo_weather_2", "geo_weather_3"],
    "spatial": ["lat", "lon", "cluster"],
    "interactions": ["rt_x_hour_le", "rt_x_lanes", "weather_x_hour_num", "weather_x_temp", "geo_hour_mean", "lv_x_lanes_num", "rush_x_rt_num", "geo_rush_mean", "temp_x_hour"],
}
#: Blocks of the base features that are taken away instead
TAKEN = {"geohash": GEO_FEATURES, "time": TIME_FEATURES, "categories": CAT_FEATURES}
KEEP, CLUSTERS, SEED = 0.1, 30, 42
CROSSED = ["hour", "is_rush_hour", "road_type_encoded", "weather_encoded", "large_vehicles_encoded", "landmarks_encoded", "number_of_lanes", "geohash"]
CROSSES = 3


def block_frame(spark, sf) -> DataFrame:
    """The model frame with the columns of all blocks; every statistic is fitted on the reference period."""
    m = model_frame(spark, sf)
    ref = ref_of(m)
    m = enc.apply_mean(m, enc.fit_mean(ref, ["geohash"], "demand"), ["geohash"], "geo_mean_demand")
    m = m.join(enc.fit_stats_many(ref, "geohash", [("number_of_lanes", "geo_lanes", ("mean", "max"), False), ("temperature", "geo_temp", ("mean", "std"), True)]), "geohash", "left")
    shares = ref.where(F.col("geohash").isNotNull()).groupBy("geohash").agg(
        *[F.avg((F.col("weather_encoded") == i).cast("double")).alias(f"geo_weather_{i}") for i in range(4)])
    m = m.join(shares, "geohash", "left")
    places = geo.geohash_decode(ref.where(F.col("geohash").isNotNull()).groupBy("geohash").agg(F.count(F.lit(1)).cast("double").alias("_w")))
    assemble = VectorAssembler(inputCols=["lat", "lon"], outputCol="_place")
    k = min(CLUSTERS, places.count())
    clusters = KMeans(k=k, seed=SEED, featuresCol="_place", weightCol="_w", predictionCol="cluster").fit(assemble.transform(places)) if k > 1 else None
    m = geo.geohash_decode(m)
    m = clusters.transform(assemble.transform(m)).drop("_place") if clusters else m.withColumn("cluster", F.lit(0))
    m = interactions_ext(m.withColumns({"temperature_filled": F.col("temperature"), "number_of_lanes_filled": F.col("number_of_lanes")}))
    m = m.withColumn("rt_x_hour", category_cross("road_type_encoded", "hour"))
    m = enc.apply_label_codes(m, enc.fit_label_codes([m], "rt_x_hour"), "rt_x_hour", "rt_x_hour_le")
    for name, key in (("geo_hour_mean", "hour"), ("geo_rush_mean", "is_rush_hour")):
        m = enc.apply_mean(m, enc.fit_composite_mean(ref, ["geohash", key], "demand"), ["geohash", key], name)
    added = [c for cols in BLOCKS.values() for c in cols]
    m = materialize(m.select("idx", "day", "demand", "log_demand", *FEATURES, *[F.col(c).cast("double").alias(c) for c in added]), "block-frame")
    return materialize(feat.apply_imputer(m, feat.fit_imputer(ref_of(m), added), added), "block-frame")


def _verdict(diff: float) -> str:
    return "keep" if diff > KEEP else "slight" if diff > 0 else "discard"


@register("ablation")
def q_ablation(spark, sf):
    """Points (100 x raw R^2 of the log-target model's demand) with and without each block: six blocks of added features (geohash mean, lanes,
    temperature, weather mix; place and clusters; interactions) against the base features, and the base blocks taken away from all features.
    keep: more than 0.1 points; slight: more than none."""
    m = block_frame(spark, sf)
    sets = {"base": BASE, "all": FEATURES, **{b: BASE + cols for b, cols in BLOCKS.items()}, **{f"without_{b}": [f for f in FEATURES if f not in cols] for b, cols in TAKEN.items()}}
    fits = FitPlan(m).run([preset_fit("gbt_b", label="log_demand", features=fs) for fs in sets.values()])
    points = {s: md.points(md.predict(x.model, tgt_of(m)).withColumn("p", _demand_of("pred")), "demand", "p") for s, x in zip(sets, fits, strict=True)}
    pairs = [(b, "added", points[b], points["base"]) for b in BLOCKS] + [(b, "taken", points["all"], points[f"without_{b}"]) for b in TAKEN]
    rows = [(b, kind, w, wo, w - wo, int(w - wo > KEEP), _verdict(w - wo)) for b, kind, w, wo in pairs]
    return spark.createDataFrame(rows, "block string, kind string, score_with double, score_without double, diff double, keep int, verdict string")


_CROSSED_SQL = {"hour": "hour", "is_rush_hour": "CASE WHEN hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 THEN 1 ELSE 0 END", "road_type": "road_type", "weather": "weather",
                "large_vehicles": "large_vehicles", "landmarks": "landmarks", "number_of_lanes": "cast(number_of_lanes AS int)", "geohash": "geohash"}


def _gains_sql() -> str:
    names = list(_CROSSED_SQL)
    text = ", ".join(f"coalesce(cast({e} AS varchar), '') AS {n}" for n, e in _CROSSED_SQL.items())

    def eps(keys):
        k = ", ".join(keys)
        return (f"(SELECT count(*) AS c, 1 - (((SELECT v * n FROM t) - sum(s * s / k) + (SELECT s * s / n FROM t)) / ((SELECT n FROM t) - count(*))) / "
                f"((SELECT v * n / (n - 1) FROM t)) AS e FROM (SELECT count(*) AS k, sum(y) AS s FROM x GROUP BY {k}) q)")

    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    body = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, p.c AS cells, {R('u.e')} AS eps2_a, {R('w.e')} AS eps2_b, {R('p.e')} AS eps2_pair, {R('p.e - greatest(u.e, w.e)')} AS gain "
                              f"FROM {eps([a, b])} p, {eps([a])} u, {eps([b])} w" for a, b in pairs)
    return with_obs(body, f"x AS (SELECT {text}, demand AS y FROM obs_t WHERE day <= 20 AND demand IS NOT NULL)",
                    "t AS (SELECT cast(count(*) AS double) AS n, sum(y) AS s, var_pop(y) AS v FROM x)")


@register("cross_gains", _gains_sql())
def q_cross_gains(spark, sf):
    """V10 + F15: what every pair of columns explains of the reference period's demand beyond its better column, from one aggregate."""
    o = ref_of(obs_t(spark, sf)).withColumns({
        "is_rush_hour": (F.col("hour").between(7, 9) | F.col("hour").between(16, 19)).cast("int"), "number_of_lanes": F.col("number_of_lanes").cast("int")})
    return round_doubles(pair_gains(o, list(_CROSSED_SQL), "demand"))


@register("cross_refit")
def q_cross_refit(spark, sf):
    """F15 + V10: the three pairs of largest gain as crossed categories (mean target of the cross, fitted on the reference period), each tested by a refit."""
    m = model_frame(spark, sf)
    ref = ref_of(m)
    best = pair_gains(ref, CROSSED, "demand").where("gain is not null").orderBy(F.col("gain").desc(), "a", "b").limit(CROSSES).collect()  # three rows
    for r in best:
        key = f"{r.a}_x_{r.b}"
        m = m.withColumn(key, category_cross(r.a, r.b))
        m = enc.apply_mean(m, enc.fit_mean(ref_of(m), [key], "demand"), [key], f"{key}_te").drop(key)
    m = materialize(m, "cross-frame")
    crosses = [f"{r.a}_x_{r.b}" for r in best]
    fits = FitPlan(m).run([preset_fit("gbt_b", label="log_demand", features=fs) for fs in [FEATURES, *[[*FEATURES, f"{c}_te"] for c in crosses]]])
    points = [md.points(md.predict(x.model, tgt_of(m)).withColumn("p", _demand_of("pred")), "demand", "p") for x in fits]
    rows = [(c, float(r.gain), p, points[0], p - points[0], _verdict(p - points[0])) for c, r, p in zip(crosses, best, points[1:], strict=True)]
    return spark.createDataFrame(rows, "cross string, gain double, score_with double, score_without double, diff double, verdict string")
