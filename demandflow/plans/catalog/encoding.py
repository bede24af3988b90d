"""E1-E12 encoder queries, J1/J2/J10 lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions import geo, time
from demandflow.functions.numeric import r6, round_doubles
from demandflow.operators import encoders as enc
from demandflow.operators import features as feat
from demandflow.operators.metrics import r2_expr, score_expr
from demandflow.plans.common import obs, obs_t, ref_of, tgt_of
from demandflow.plans.registry import R, register, with_obs
from demandflow.session import materialize

_REF = "ref AS (SELECT * FROM obs_t WHERE day <= 20)"
_TGT = "tgt AS (SELECT * FROM obs_t WHERE day > 20)"
_G = "g AS (SELECT avg(demand) AS g FROM ref)"


@register("te_smoothed", with_obs(f"""
SELECT o.idx, o.geohash, {R('coalesce((s.m * s.n + g.g * 10) / (s.n + 10), g.g)')} AS te_geohash
FROM obs o LEFT JOIN (SELECT geohash, avg(demand) AS m, count(demand) AS n FROM ref
                      WHERE geohash IS NOT NULL GROUP BY geohash) s ON o.geohash = s.geohash
CROSS JOIN g""", _REF, _G))
def q_te_smoothed(spark, sf):
    """Smoothed geohash encoding (alpha 10) fit on the reference period, applied to all rows."""
    o = obs(spark, sf)
    fitted = enc.fit_smoothed(ref_of(o), ["geohash"], "demand", alpha=10.0)
    out = enc.apply_smoothed(o, fitted, ["geohash"], "te_geohash")
    return out.select("idx", "geohash", r6("te_geohash").alias("te_geohash"))


@register("te_mean", with_obs(f"""
SELECT t.idx, {R('coalesce(s.m, g.g)')} AS te_mean
FROM tgt t LEFT JOIN (SELECT geohash, avg(demand) AS m FROM ref GROUP BY geohash) s ON t.geohash = s.geohash
CROSS JOIN g""", _REF, _TGT, _G))
def q_te_mean(spark, sf):
    """E2 + J2 + J10: mean geohash encoding, unseen -> reference-period mean."""
    o = obs(spark, sf)
    out = enc.apply_mean(tgt_of(o), enc.fit_mean(ref_of(o), ["geohash"], "demand"), ["geohash"], "te_mean")
    return out.select("idx", r6("te_mean").alias("te_mean"))


@register("te_median", with_obs(f"""
SELECT t.idx, {R('coalesce(s.m, gm.g)')} AS te_median
FROM tgt t LEFT JOIN (SELECT geohash, quantile_cont(demand, 0.5) AS m FROM ref GROUP BY geohash) s
  ON t.geohash = s.geohash
CROSS JOIN (SELECT quantile_cont(demand, 0.5) AS g FROM ref) gm""", _REF, _TGT))
def q_te_median(spark, sf):
    """Exact median geohash encoding, unseen -> reference-period median."""
    o = obs(spark, sf)
    out = enc.apply_mean(tgt_of(o), enc.fit_median(ref_of(o), ["geohash"], "demand"), ["geohash"], "te_median")
    return out.select("idx", r6("te_median").alias("te_median"))


_RUSH = "cast(hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 AS int)"


@register("te_composite", with_obs(f"""
SELECT t.idx, {R('coalesce(a.m, g.g)')} AS geo_hour_mean, {R('coalesce(b.m, g.g)')} AS geo_rush_mean
FROM tgt t
LEFT JOIN (SELECT geohash, hour, avg(demand) AS m FROM ref GROUP BY geohash, hour) a
  ON t.geohash = a.geohash AND t.hour = a.hour
LEFT JOIN (SELECT geohash, {_RUSH} AS rush, avg(demand) AS m FROM ref GROUP BY geohash, {_RUSH}) b
  ON t.geohash = b.geohash AND {_RUSH.replace('hour', 't.hour')} = b.rush
CROSS JOIN g""", _REF, _TGT, _G))
def q_te_composite(spark, sf):
    """E5: composite-key mean encodings (geohash x hour, geohash x rush flag)."""
    o = time.rush_flags(obs_t(spark, sf))
    ref, tgt = ref_of(o), tgt_of(o)
    out = enc.apply_mean(tgt, enc.fit_composite_mean(ref, ["geohash", "hour"], "demand"),
                         ["geohash", "hour"], "geo_hour_mean")
    out = enc.apply_mean(out, enc.fit_composite_mean(ref, ["geohash", "is_rush_hour"], "demand"),
                         ["geohash", "is_rush_hour"], "geo_rush_mean")
    return round_doubles(out.select("idx", "geo_hour_mean", "geo_rush_mean"))


def _freq_sql(col):
    return (f"LEFT JOIN (SELECT {col} AS k, count(*) / sum(count(*)) OVER () AS f FROM ref "
            f"WHERE {col} IS NOT NULL GROUP BY {col}) f_{col} ON o.{col} = f_{col}.k")


_FREQ_COLS = ["road_type", "weather", "large_vehicles", "geohash"]


@register("freq_encode", with_obs(
    "SELECT o.idx, " + ", ".join(f"{R(f'coalesce(f_{c}.f, 0.0)')} AS freq_{c}" for c in _FREQ_COLS)
    + " FROM obs o " + " ".join(_freq_sql(c) for c in _FREQ_COLS), _REF))
def q_freq_encode(spark, sf):
    """Frequency encoding (share among non-null reference rows; unseen/null -> 0)."""
    o = obs(spark, sf)
    ref = ref_of(o)
    out = o
    for c in _FREQ_COLS:
        out = enc.apply_frequency(out, enc.fit_frequency(ref, c), c, f"freq_{c}")
    return round_doubles(out.select("idx", *[f"freq_{c}" for c in _FREQ_COLS]))


@register("geo_weather_mix", with_obs(
    "SELECT t.idx, " + ", ".join(f"{R(f'm.w{i}')} AS geo_weather_{i}" for i in range(4)) + f""", {R('m.w_other')} AS geo_weather_other
FROM tgt t LEFT JOIN (SELECT geohash,
  avg(CASE WHEN weather NOT IN ('Sunny', 'Cloudy', 'Rainy', 'Snowy') THEN 1.0 ELSE 0.0 END) AS w_other,
  avg(CASE WHEN weather = 'Sunny' THEN 1.0 ELSE 0.0 END) AS w0, avg(CASE WHEN weather = 'Cloudy' THEN 1.0 ELSE 0.0 END) AS w1,
  avg(CASE WHEN weather = 'Rainy' THEN 1.0 ELSE 0.0 END) AS w2, avg(CASE WHEN weather = 'Snowy' THEN 1.0 ELSE 0.0 END) AS w3
  FROM ref GROUP BY geohash) m ON t.geohash = m.geohash""", _REF, _TGT))
def q_geo_weather_mix(spark, sf):
    """E7 + F21: per-geohash weather level shares (one-hot then mean), left-joined."""
    o = obs(spark, sf)
    mix = enc.fit_level_mix(ref_of(o), "geohash", "weather")
    out = tgt_of(o).join(mix, on="geohash", how="left")
    return round_doubles(out.select("idx", *[f"geo_weather_{i}" for i in (0, 1, 2, 3, "other")]))


@register("geo_weather_onehot", with_obs(
    "SELECT t.idx, " + ", ".join(f"{R(f'm.w_{w}')} AS geo_weather_{w}" for w in ("Cloudy", "Rainy", "Snowy", "Sunny")) + """
FROM tgt t LEFT JOIN (SELECT geohash, """ + ", ".join(
        f"sum(CASE WHEN weather = '{w}' THEN 1 ELSE 0 END) / cast(count(*) AS double) AS w_{w}" for w in ("Cloudy", "Rainy", "Snowy", "Sunny"))
    + " FROM ref GROUP BY geohash) m ON t.geohash = m.geohash", _REF, _TGT))
def q_geo_weather_onehot(spark, sf):
    """one-hot by the levels that the reference period shows, mean per geohash, left-joined."""
    o = obs(spark, sf)
    mix = enc.observed_level_mix(ref_of(o), "geohash", "weather", "geo_weather")
    return round_doubles(tgt_of(o).select("idx", "geohash").join(mix, on="geohash", how="left").drop("geohash"))


_FILLED_ALL = """filled AS (SELECT o.*, coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM obs)) AS tf,
  coalesce(number_of_lanes, (SELECT quantile_cont(number_of_lanes, 0.5) FROM obs)) AS lf FROM obs_t o)"""


@register("geo_stats", with_obs(f"""
SELECT t.idx, {R('a.tmean')} AS geohash_temp_mean, {R('a.tstd')} AS geohash_temp_std,
  {R('a.tmin')} AS geohash_temp_min, {R('a.tmax')} AS geohash_temp_max,
  {R('b.tmean')} AS geohash_prefix_4_temp_mean, {R('b.tstd')} AS geohash_prefix_4_temp_std,
  {R('b.tmin')} AS geohash_prefix_4_temp_min, {R('b.tmax')} AS geohash_prefix_4_temp_max,
  {R('a.lmean')} AS geo_lanes_mean, {R('a.lmax')} AS geo_lanes_max,
  {R('a.tmean')} AS geo_temp_mean, {R('coalesce(a.tstd, 0.0)')} AS geo_temp_std
FROM (SELECT * FROM filled WHERE day > 20) t
LEFT JOIN (SELECT geohash, avg(tf) AS tmean, stddev_samp(tf) AS tstd, min(tf) AS tmin, max(tf) AS tmax,
                  avg(lf) AS lmean, max(lf) AS lmax FROM filled WHERE day <= 20 GROUP BY geohash) a
  ON t.geohash = a.geohash
LEFT JOIN (SELECT substr(geohash, 1, 4) AS p4, avg(tf) AS tmean, stddev_samp(tf) AS tstd, min(tf) AS tmin,
                  max(tf) AS tmax FROM filled WHERE day <= 20 GROUP BY substr(geohash, 1, 4)) b
  ON substr(t.geohash, 1, 4) = b.p4""", _FILLED_ALL))
def q_geo_stats(spark, sf):
    """E8 + A4 + J1: per-key numeric stats (mean/std/min/max) fit on the reference
    period and left-joined onto target rows."""
    o = feat.median_fill(obs(spark, sf), ["temperature", "number_of_lanes"])
    o = o.withColumn("geohash_prefix_4", geo.geohash_prefix("geohash", 4))
    ref, tgt = ref_of(o), tgt_of(o)
    # every geohash-keyed statistic in one aggregate, the prefix-keyed ones in another
    a = enc.fit_stats_many(ref, "geohash", [
        ("temperature_filled", "geohash_temp", ("mean", "std", "min", "max"), False),
        ("number_of_lanes_filled", "geo_lanes", ("mean", "max"), False),
        ("temperature_filled", "geo_temp", ("mean", "std"), True)])
    b = enc.fit_group_stats(ref, "geohash_prefix_4", "temperature_filled", "geohash_prefix_4_temp")
    out = tgt.join(a, "geohash", "left").join(b, "geohash_prefix_4", "left")
    cols = ["geohash_temp_mean", "geohash_temp_std", "geohash_temp_min", "geohash_temp_max",
            "geohash_prefix_4_temp_mean", "geohash_prefix_4_temp_std", "geohash_prefix_4_temp_min",
            "geohash_prefix_4_temp_max", "geo_lanes_mean", "geo_lanes_max", "geo_temp_mean", "geo_temp_std"]
    return round_doubles(out.select("idx", *cols))


@register("geo_count", with_obs("""
SELECT o.idx, c.n AS geohash_count, c4.n AS geohash_prefix_4_count
FROM obs o LEFT JOIN (SELECT geohash, count(*) AS n FROM ref GROUP BY geohash) c ON o.geohash = c.geohash
LEFT JOIN (SELECT substr(geohash, 1, 4) AS p4, count(*) AS n FROM ref GROUP BY substr(geohash, 1, 4)) c4
  ON substr(o.geohash, 1, 4) = c4.p4""", _REF))
def q_geo_count(spark, sf):
    """E9 + A5: rows per key in the reference period, left-joined (unseen -> null)."""
    o = obs(spark, sf).withColumn("geohash_prefix_4", geo.geohash_prefix("geohash", 4))
    ref = ref_of(o)
    out = (o.join(enc.fit_group_count(ref, "geohash", "geohash_count"), "geohash", "left")
            .join(enc.fit_group_count(ref, "geohash_prefix_4", "geohash_prefix_4_count"), "geohash_prefix_4", "left"))
    return out.select("idx", "geohash_count", "geohash_prefix_4_count")


_TE_COLS = ["geohash", "geohash_prefix_3", "geohash_prefix_4", "geohash_prefix_5", "hour", "slot",
            "day_of_week", "road_type", "weather"]
_TE_EXPR = {"geohash_prefix_3": "substr(geohash, 1, 3)", "geohash_prefix_4": "substr(geohash, 1, 4)",
            "geohash_prefix_5": "substr(geohash, 1, 5)", "day_of_week": "(((day % 7) + 7) % 7)"}


def _te_sql():
    parts, joins = [], []
    for c in _TE_COLS:
        e = _TE_EXPR.get(c, c)
        parts.append(f"{R(f'coalesce((s_{c}.m * s_{c}.n + g.g * 10) / (s_{c}.n + 10), g.g)')} AS te_{c}")
        joins.append(f"LEFT JOIN (SELECT {e} AS k, avg(demand) AS m, count(demand) AS n FROM ref "
                     f"WHERE {e} IS NOT NULL GROUP BY {e}) s_{c} ON ({e.replace('geohash', 't.geohash').replace('day', 't.day')}) = s_{c}.k"
                     if c in _TE_EXPR else
                     f"LEFT JOIN (SELECT {c} AS k, avg(demand) AS m, count(demand) AS n FROM ref "
                     f"WHERE {c} IS NOT NULL GROUP BY {c}) s_{c} ON t.{c} = s_{c}.k")
    return "SELECT t.idx, " + ", ".join(parts) + " FROM tgt t CROSS JOIN g " + " ".join(joins)


@register("te_period_fit", with_obs(_te_sql(), _REF, _TGT, _G))
def q_te_period_fit(spark, sf):
    """E11 + E4 for nine columns: all encodings fit on the reference period in one
    GROUPING SETS pass, applied to the target period."""
    o = obs_t(spark, sf).withColumns({
        "geohash_prefix_3": geo.geohash_prefix("geohash", 3), "geohash_prefix_4": geo.geohash_prefix("geohash", 4),
        "geohash_prefix_5": geo.geohash_prefix("geohash", 5), "day_of_week": F.pmod(F.col("day"), F.lit(7))})
    # the fitted long table is read by nine joins: persist it once (one GROUPING SETS pass)
    long = materialize(enc.fit_smoothed_many(ref_of(o), _TE_COLS, "demand", alpha=10.0), "te-long")
    out = enc.apply_long(tgt_of(o), long, _TE_COLS, ref_of(o).agg(F.avg("demand").alias("g")), "te_")
    return round_doubles(out.select("idx", *[f"te_{c}" for c in _TE_COLS]))


@register("label_encode", with_obs("""
SELECT u.idx, cast(a.code AS int) AS road_type_le, cast(b.code AS int) AS weather_le,
       cast(c.code AS int) AS geohash_prefix_3_le
FROM u
JOIN (SELECT rt, row_number() OVER (ORDER BY rt) - 1 AS code FROM (SELECT DISTINCT rt FROM u) x) a USING (rt)
JOIN (SELECT wt, row_number() OVER (ORDER BY wt) - 1 AS code FROM (SELECT DISTINCT wt FROM u) x) b USING (wt)
JOIN (SELECT p3, row_number() OVER (ORDER BY p3) - 1 AS code FROM (SELECT DISTINCT p3 FROM u) x) c USING (p3)""",
    "u AS (SELECT coalesce(road_type, 'nan') AS rt, coalesce(weather, 'nan') AS wt, "
    "coalesce(substr(geohash, 1, 3), 'nan') AS p3, idx FROM obs)"))
def q_label_encode(spark, sf):
    """Label codes over train U test (reference U target period), null -> 'nan',
    codes in code-point order."""
    o = obs(spark, sf).withColumn("geohash_prefix_3", geo.geohash_prefix("geohash", 3))
    ref, tgt = ref_of(o), tgt_of(o)
    cols = ["road_type", "weather", "geohash_prefix_3"]
    # one numbering pass for all columns; the small code table is written once and read by three joins
    codes = materialize(enc.fit_label_codes_many([ref, tgt], cols), "label-codes")
    out = enc.apply_label_codes_many(o, codes, cols)
    return out.select("idx", "road_type_le", "weather_le", "geohash_prefix_3_le")


_BAKE_E = """e AS (
  SELECT t.demand, coalesce(a.m, g.g) AS te_mean, coalesce(b.m, gm.g) AS te_median,
         coalesce((a.m * a.n + g.g * 10) / (a.n + 10), g.g) AS te_smooth
  FROM tgt t
  LEFT JOIN (SELECT geohash, avg(demand) AS m, count(demand) AS n FROM ref GROUP BY geohash) a USING (geohash)
  LEFT JOIN (SELECT geohash, quantile_cont(demand, 0.5) AS m FROM ref GROUP BY geohash) b USING (geohash)
  CROSS JOIN g CROSS JOIN (SELECT quantile_cont(demand, 0.5) AS g FROM ref) gm)"""
_BAKE_S = """s AS (
  SELECT 'mean' AS encoding, 1 - sum((demand - te_mean) * (demand - te_mean)) / (var_pop(demand) * count(*)) AS r2 FROM e
  UNION ALL SELECT 'median', 1 - sum((demand - te_median) * (demand - te_median)) / (var_pop(demand) * count(*)) FROM e
  UNION ALL SELECT 'smoothed', 1 - sum((demand - te_smooth) * (demand - te_smooth)) / (var_pop(demand) * count(*)) FROM e)"""


@register("encoding_bakeoff", with_obs(f"""
SELECT encoding, {R('r2')} AS r2, {R('greatest(0.0, 100 * r2)')} AS score,
       cast(row_number() OVER (ORDER BY r2 DESC, encoding) = 1 AS int) AS is_best
FROM s""", _REF, _TGT, _G, _BAKE_E, _BAKE_S))
def q_encoding_bakeoff(spark, sf):
    """Mean vs median vs smoothed geohash encodings, each scored directly as a
    predictor of target-period demand (R^2); best by raw R^2 with a name tie-break."""
    from demandflow.operators.ensemble import rank_scores
    o = obs(spark, sf)
    ref, tgt = ref_of(o), tgt_of(o)
    e = enc.apply_mean(tgt, enc.fit_mean(ref, ["geohash"], "demand"), ["geohash"], "te_mean")
    e = enc.apply_mean(e, enc.fit_median(ref, ["geohash"], "demand"), ["geohash"], "te_median")
    e = enc.apply_smoothed(e, enc.fit_smoothed(ref, ["geohash"], "demand"), ["geohash"], "te_smooth")
    s = e.agg(*[r2_expr("demand", c).alias(n) for c, n in
                [("te_mean", "mean"), ("te_median", "median"), ("te_smooth", "smoothed")]])
    long = s.select(F.explode(F.array(*[F.struct(F.lit(n).alias("encoding"), F.col(n).alias("r2"))
                                        for n in ["mean", "median", "smoothed"]])).alias("x")).select("x.*")
    long = long.withColumn("score", score_expr(F.col("r2")))
    return round_doubles(rank_scores(long, "r2", "encoding"))
