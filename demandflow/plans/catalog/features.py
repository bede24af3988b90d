"""Projections, predicates and scalar features over ``obs``."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions import categorical as cat
from demandflow.functions import geo, numeric, time
from demandflow.functions.numeric import round_doubles
from demandflow.operators import features as feat
from demandflow.plans.common import obs, ref_of
from demandflow.plans.registry import R, register, with_obs


@register("parse_time", with_obs("SELECT idx, hour, minute FROM obs_t"))
def q_parse_time(spark, sf):
    return time.parse_time(obs(spark, sf)).select("idx", "hour", "minute")


@register("time_slots", with_obs("""
SELECT idx, hour * 4 + cast(floor(minute / 15) AS int) AS quarter_hour,
       hour * 2 + cast(floor(minute / 30) AS int) AS time_bucket_30min,
       cast(floor(hour / 2) AS int) AS time_bucket_2hr, cast(floor(hour / 3) AS int) AS time_bucket_3hr,
       cast(floor(hour / 4) AS int) AS time_bucket_4hr, cast(floor(hour / 6) AS int) AS time_bucket_6hr,
       hour * 60 + minute AS minutes_since_midnight
FROM obs_t"""))
def q_time_slots(spark, sf):
    df = time.time_slots(time.parse_time(obs(spark, sf)))
    return df.select("idx", "quarter_hour", "time_bucket_30min", "time_bucket_2hr", "time_bucket_3hr",
                     "time_bucket_4hr", "time_bucket_6hr", "minutes_since_midnight")


_RUSH_SQL = with_obs("""
SELECT idx,
  cast(hour BETWEEN 7 AND 9 AS int) AS is_morning_rush,
  cast(hour BETWEEN 16 AND 19 AS int) AS is_evening_rush,
  cast(hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 AS int) AS is_rush_hour,
  cast(hour >= 22 OR hour <= 5 AS int) AS is_night,
  cast(hour BETWEEN 0 AND 4 AS int) AS is_late_night,
  cast(hour BETWEEN 9 AND 17 AS int) AS is_business_hours,
  cast(hour BETWEEN 8 AND 9 AS int) AS is_peak_morning,
  cast(hour BETWEEN 17 AND 18 AS int) AS is_peak_evening
FROM obs_t""")


@register("rush_flags", _RUSH_SQL)
def q_rush_flags(spark, sf):
    df = time.rush_flags(time.parse_time(obs(spark, sf)))
    return df.select("idx", "is_morning_rush", "is_evening_rush", "is_rush_hour", "is_night",
                     "is_late_night", "is_business_hours", "is_peak_morning", "is_peak_evening")


def _cyc_sql(name, expr, period):
    return (f"{R(f'sin(2 * pi() * ({expr}) / {period}.0)')} AS {name}_sin, "
            f"{R(f'cos(2 * pi() * ({expr}) / {period}.0)')} AS {name}_cos")


@register("cyclic_time", with_obs(f"""
SELECT idx, {_cyc_sql('hour', 'hour', 24)}, {_cyc_sql('minute', 'minute', 60)},
       {_cyc_sql('quarter_hour', 'slot', 96)}, {_cyc_sql('day_of_week', '((day % 7) + 7) % 7', 7)}
FROM obs_t"""))
def q_cyclic_time(spark, sf):
    df = time.all_time_features(obs(spark, sf))
    cols = [f"{n}_{f}" for n in ("hour", "minute", "quarter_hour", "day_of_week") for f in ("sin", "cos")]
    return round_doubles(df.select("idx", *cols))


@register("day_features", with_obs("""
SELECT idx, ((day % 7) + 7) % 7 AS day_of_week,
       cast(((day % 7) + 7) % 7 IN (5, 6) AS int) AS is_weekend,
       1 - cast(((day % 7) + 7) % 7 IN (5, 6) AS int) AS is_weekday,
       cast(floor(day / 7) AS int) AS week_number
FROM obs"""))
def q_day_features(spark, sf):
    return time.day_features(obs(spark, sf)).select("idx", "day_of_week", "is_weekend", "is_weekday",
                                                    "week_number")


@register("geohash_parts", with_obs("""
SELECT idx, substr(geohash, 1, 1) AS geohash_char_0, substr(geohash, 2, 1) AS geohash_char_1,
       substr(geohash, 3, 1) AS geohash_char_2, substr(geohash, 4, 1) AS geohash_char_3,
       substr(geohash, 5, 1) AS geohash_char_4, substr(geohash, 6, 1) AS geohash_char_5,
       substr(geohash, 1, 3) AS geohash_prefix_3, substr(geohash, 1, 4) AS geohash_prefix_4,
       substr(geohash, 1, 5) AS geohash_prefix_5
FROM obs"""))
def q_geohash_parts(spark, sf):
    return feat.geohash_parts(obs(spark, sf)).drop(
        "geohash", "day", "timestamp", "demand", "road_type", "number_of_lanes", "large_vehicles",
        "landmarks", "temperature", "weather")


_ORD_SQL = with_obs("""
SELECT idx,
  CASE road_type WHEN 'Residential' THEN 0 WHEN 'Commercial' THEN 1 WHEN 'Highway' THEN 2 END AS road_type_encoded,
  CASE large_vehicles WHEN 'Not Allowed' THEN 0 WHEN 'Allowed' THEN 1 END AS large_vehicles_encoded,
  CASE landmarks WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS landmarks_encoded,
  CASE weather WHEN 'Sunny' THEN 0 WHEN 'Cloudy' THEN 1 WHEN 'Rainy' THEN 2 WHEN 'Snowy' THEN 3 END AS weather_encoded
FROM obs""")


@register("ordinal_encode", _ORD_SQL)
def q_ordinal_encode(spark, sf):
    return cat.ordinal_encode(obs(spark, sf)).select(
        "idx", "road_type_encoded", "large_vehicles_encoded", "landmarks_encoded", "weather_encoded")


@register("missing_flags", with_obs("""
SELECT idx, cast(road_type IS NULL AS int) AS road_type_missing,
  cast(temperature IS NULL AS int) AS temperature_missing, cast(weather IS NULL AS int) AS weather_missing,
  cast(landmarks IS NULL AS int) AS landmarks_missing, cast(large_vehicles IS NULL AS int) AS large_vehicles_missing,
  cast(number_of_lanes IS NULL AS int) AS number_of_lanes_missing,
  cast(road_type IS NULL AS int) + cast(temperature IS NULL AS int) + cast(weather IS NULL AS int)
   + cast(landmarks IS NULL AS int) + cast(large_vehicles IS NULL AS int) + cast(number_of_lanes IS NULL AS int)
   AS n_missing
FROM obs"""))
def q_missing_flags(spark, sf):
    df = cat.missing_flags(obs(spark, sf))
    return df.select("idx", *[f"{c}_missing" for c in cat.MISSING_CHECK_COLUMNS], "n_missing")


_MED = """med AS (SELECT quantile_cont(temperature, 0.5) AS t_med,
                      quantile_cont(number_of_lanes, 0.5) AS l_med FROM obs)"""
_FILLED = """filled AS (SELECT o.*, coalesce(temperature, t_med) AS temperature_filled,
                        coalesce(number_of_lanes, l_med) AS number_of_lanes_filled
                 FROM obs_t o CROSS JOIN med)"""


@register("median_fill", with_obs(f"""
SELECT idx, {R('temperature_filled')} AS temperature_filled,
       {R('number_of_lanes_filled')} AS number_of_lanes_filled FROM filled""", _MED, _FILLED))
def q_median_fill(spark, sf):
    df = feat.median_fill(obs(spark, sf), ["temperature", "number_of_lanes"])
    return round_doubles(df.select("idx", "temperature_filled", "number_of_lanes_filled"))


def _cut_sql(col, n):
    terms = " + ".join(f"cast({col} > mn + {i} * ((mx - mn) / {n}) AS int)" for i in range(1, n))
    return f"CASE WHEN mx = mn THEN {(n - 1) // 2} ELSE {terms} END"


@register("equal_width_bins", with_obs(f"""
SELECT idx, {_cut_sql('temperature_filled', 5)} AS temp_bin_5, {_cut_sql('temperature_filled', 10)} AS temp_bin_10
FROM filled CROSS JOIN (SELECT min(temperature_filled) AS mn, max(temperature_filled) AS mx FROM filled) r
""", _MED, _FILLED))
def q_equal_width_bins(spark, sf):
    df = feat.median_fill(obs(spark, sf), ["temperature", "number_of_lanes"])
    df = feat.equal_width_bins(df, "temperature_filled", {"temp_bin_5": 5, "temp_bin_10": 10})
    return df.select("idx", "temp_bin_5", "temp_bin_10")


@register("threshold_features", with_obs(f"""
SELECT idx, cast(temperature_filled < 10 AS int) AS is_cold, cast(temperature_filled > 35 AS int) AS is_hot,
       {R('abs(temperature_filled - 25)')} AS temp_abs_from_25,
       cast(number_of_lanes_filled >= 3 AS int) AS is_multilane
FROM filled""", _MED, _FILLED))
def q_threshold_features(spark, sf):
    df = feat.median_fill(obs(spark, sf), ["temperature", "number_of_lanes"])
    df = numeric.threshold_features(df)
    return round_doubles(df.select("idx", "is_cold", "is_hot", "temp_abs_from_25", "is_multilane"))


_ENC = """enc AS (
  SELECT f.*,
    CASE road_type WHEN 'Residential' THEN 0 WHEN 'Commercial' THEN 1 WHEN 'Highway' THEN 2 END AS rt,
    CASE large_vehicles WHEN 'Not Allowed' THEN 0 WHEN 'Allowed' THEN 1 END AS lv,
    CASE landmarks WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS lm,
    CASE weather WHEN 'Sunny' THEN 0 WHEN 'Cloudy' THEN 1 WHEN 'Rainy' THEN 2 WHEN 'Snowy' THEN 3 END AS wt,
    cast(hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 AS int) AS rush,
    cast(hour >= 22 OR hour <= 5 AS int) AS night,
    cast(((day % 7) + 7) % 7 IN (5, 6) AS int) AS weekend
  FROM filled f)"""


def _feature_frame(spark, sf):
    df = obs(spark, sf)
    df = time.all_time_features(df)
    df = cat.ordinal_encode(df)
    return feat.median_fill(df, ["temperature", "number_of_lanes"])


@register("interactions", with_obs(f"""
SELECT idx,
  {R('rush * coalesce(rt, -1)')} AS rush_x_roadtype,
  {R('night * temperature_filled')} AS night_x_temp,
  {R('weekend * hour')} AS weekend_x_hour,
  {R('rush * number_of_lanes_filled')} AS rush_x_lanes,
  {R('coalesce(wt, -1) * hour')} AS weather_x_hour,
  {R('coalesce(lm, 0) * rush')} AS landmarks_x_rush,
  {R('coalesce(lv, 0) * number_of_lanes_filled')} AS lv_x_lanes,
  {R('temperature_filled * coalesce(wt, 0)')} AS temp_x_weather,
  {R('hour * coalesce(lv, 0)')} AS hour_x_lv
FROM enc""", _MED, _FILLED, _ENC))
def q_interactions(spark, sf):
    df = numeric.interactions(_feature_frame(spark, sf))
    return round_doubles(df.select("idx", "rush_x_roadtype", "night_x_temp", "weekend_x_hour", "rush_x_lanes",
                                   "weather_x_hour", "landmarks_x_rush", "lv_x_lanes", "temp_x_weather",
                                   "hour_x_lv"))


@register("interactions_ext", with_obs(f"""
SELECT idx,
  {R('coalesce(rt, -1) * number_of_lanes_filled')} AS rt_x_lanes,
  {R('coalesce(wt, -1) * hour')} AS weather_x_hour_num,
  {R('coalesce(wt, -1) * temperature_filled')} AS weather_x_temp,
  {R('coalesce(lv, -1) * number_of_lanes_filled')} AS lv_x_lanes_num,
  {R('rush * coalesce(rt, -1)')} AS rush_x_rt_num,
  {R('temperature_filled * hour')} AS temp_x_hour
FROM enc""", _MED, _FILLED, _ENC))
def q_interactions_ext(spark, sf):
    df = numeric.interactions_ext(_feature_frame(spark, sf))
    return round_doubles(df.select("idx", "rt_x_lanes", "weather_x_hour_num", "weather_x_temp",
                                   "lv_x_lanes_num", "rush_x_rt_num", "temp_x_hour"))


@register("category_cross", with_obs("""
SELECT c.idx, c.rt_x_hour, cast(d.code AS int) AS rt_x_hour_code
FROM crossed c JOIN (SELECT rt_x_hour, row_number() OVER (ORDER BY rt_x_hour) - 1 AS code
                     FROM (SELECT DISTINCT rt_x_hour FROM crossed) u) d USING (rt_x_hour)""",
    _MED, _FILLED, _ENC,
    "crossed AS (SELECT idx, concat_ws('_', coalesce(cast(rt AS varchar), 'nan'), cast(hour AS varchar)) AS rt_x_hour"
    " FROM enc)"))
def q_category_cross(spark, sf):
    from demandflow.operators.encoders import apply_label_codes, fit_label_codes
    df = cat.ordinal_encode(time.parse_time(obs(spark, sf)))
    df = df.withColumn("rt_x_hour", cat.category_cross("road_type_encoded", "hour"))
    codes = fit_label_codes([df], "rt_x_hour")
    return apply_label_codes(df, codes, "rt_x_hour", "rt_x_hour_code").select("idx", "rt_x_hour", "rt_x_hour_code")


@register("sentinel_fill", with_obs("""
SELECT idx, coalesce(road_type, 'MISSING') AS road_type_filled, coalesce(weather, 'MISSING') AS weather_filled
FROM obs"""))
def q_sentinel_fill(spark, sf):
    df = obs(spark, sf)
    return df.select("idx", cat.sentinel("road_type").alias("road_type_filled"),
                     cat.sentinel("weather").alias("weather_filled"))


def _geo_decode_sql(col: str = "geohash", max_len: int = geo.MAX_GEOHASH_LEN) -> tuple[str, str]:
    """SQL twin of ``geo.geohash_decode_cols`` (generated from the same bit rule)."""
    alpha = geo.GEOHASH_ALPHABET
    n = f"least(length({col}), {max_len})"
    lat_terms, lon_terms, bad = [], [], []
    j = lat_k = lon_k = 0
    for i in range(max_len):
        d = f"(instr('{alpha}', substr({col}, {i + 1}, 1)) - 1)"
        bad.append(f"({n} > {i} AND {d} < 0)")
        for k in range(5):
            bit = f"(CASE WHEN {n} > {i} AND {d} >= 0 THEN cast(floor({d} / {2 ** (4 - k)}) AS bigint) % 2 ELSE 0 END)"
            if j % 2 == 0:
                lon_terms.append(f"{bit} * {360.0 / 2 ** (lon_k + 1)!r}")
                lon_k += 1
            else:
                lat_terms.append(f"{bit} * {180.0 / 2 ** (lat_k + 1)!r}")
                lat_k += 1
            j += 1
    lat = f"(-90.0 + {' + '.join(lat_terms)} + 90.0 / pow(2.0, floor({n} * 5 / 2)))"
    lon = f"(-180.0 + {' + '.join(lon_terms)} + 180.0 / pow(2.0, floor(({n} * 5 + 1) / 2)))"
    badc = " OR ".join(bad)
    lat = f"CASE WHEN {col} IS NULL THEN 0.0 WHEN {badc} THEN NULL ELSE {lat} END"
    lon = f"CASE WHEN {col} IS NULL THEN 0.0 WHEN {badc} THEN NULL ELSE {lon} END"
    return lat, lon


_LAT, _LON = _geo_decode_sql()


@register("geohash_decode", with_obs(f"""
SELECT geohash, {R(_LAT)} AS lat, {R(_LON)} AS lon FROM (SELECT DISTINCT geohash FROM obs) g"""))
def q_geohash_decode(spark, sf):
    df = obs(spark, sf).select("geohash").distinct()
    return round_doubles(geo.geohash_decode(df))


@register("target_transform", with_obs(f"""
SELECT idx, {R('ln(1 + demand)')} AS log_demand, {R('exp(ln(1 + demand)) - 1')} AS demand_back FROM obs"""))
def q_target_transform(spark, sf):
    df = obs(spark, sf).withColumn("log_demand", numeric.log_target("demand"))
    df = df.withColumn("demand_back", numeric.exp_target("log_demand"))
    return round_doubles(df.select("idx", "log_demand", "demand_back"))


@register("clip_predictions", with_obs(f"""
SELECT idx,
  {R("CASE WHEN demand * 3 - 1 IS NULL THEN NULL WHEN demand * 3 - 1 < 0 THEN 0.0 WHEN demand * 3 - 1 > 1 THEN 1.0 ELSE demand * 3 - 1 END")} AS clipped,
  {R("CASE WHEN temperature / 10 IS NULL THEN NULL WHEN temperature / 10 < 0 THEN 0.0 ELSE temperature / 10 END")} AS clipped_lower
FROM obs"""))
def q_clip_predictions(spark, sf):
    df = obs(spark, sf)
    df = df.select("idx", numeric.clip(F.col("demand") * 3 - 1, 0.0, 1.0).alias("clipped"),
                   numeric.clip(F.col("temperature") / 10, 0.0, None).alias("clipped_lower"))
    return round_doubles(df)


_IMPUTE_COLS = ["temperature", "number_of_lanes", "road_type_encoded", "weather_encoded"]


@register("impute_matrix", with_obs(f"""
SELECT idx, {R('coalesce(temperature, m_t)')} AS temperature, {R('coalesce(number_of_lanes, m_l)')} AS number_of_lanes,
       {R('coalesce(cast(rt AS double), m_r)')} AS road_type_encoded,
       {R('coalesce(cast(wt AS double), m_w)')} AS weather_encoded
FROM enc CROSS JOIN (
  SELECT quantile_cont(temperature, 0.5) AS m_t, quantile_cont(number_of_lanes, 0.5) AS m_l,
         quantile_cont(rt, 0.5) AS m_r, quantile_cont(wt, 0.5) AS m_w
  FROM enc WHERE day <= 20) m""", _MED, _FILLED, _ENC))
def q_impute_matrix(spark, sf):
    df = cat.ordinal_encode(obs(spark, sf))
    fitted = feat.fit_imputer(ref_of(df), _IMPUTE_COLS)
    out = feat.apply_imputer(df, fitted, _IMPUTE_COLS)
    return round_doubles(out.select("idx", *_IMPUTE_COLS))


@register("compact_features", with_obs(f"""
SELECT idx, hour, minute, substr(geohash, 1, 5) AS geohash_prefix_5, number_of_lanes,
  CASE road_type WHEN 'Residential' THEN 0 WHEN 'Commercial' THEN 1 WHEN 'Highway' THEN 2 END AS road_type_encoded,
  cast(road_type IS NULL AS int) AS road_type_missing,
  CASE large_vehicles WHEN 'Not Allowed' THEN 0 WHEN 'Allowed' THEN 1 END AS large_vehicles_encoded,
  CASE landmarks WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS landmarks_encoded,
  cast(road_type IS NULL AS int) + cast(temperature IS NULL AS int) + cast(weather IS NULL AS int)
   + cast(landmarks IS NULL AS int) + cast(large_vehicles IS NULL AS int) + cast(number_of_lanes IS NULL AS int)
   AS n_missing,
  hour * CASE large_vehicles WHEN 'Allowed' THEN 1 ELSE 0 END AS hour_x_lv,
  {R('temperature_filled')} AS temperature_filled, {R('abs(temperature_filled - 25)')} AS temp_abs_from_25,
  {R(_LAT)} AS lat, {R(_LON)} AS lon,
  {', '.join(f'substr(geohash, {i + 1}, 1) AS geohash_char_{i}' for i in range(6))}
FROM filled""", _MED, _FILLED))
def q_compact_features(spark, sf):
    """the short profile: time, geohash parts and centre, road, vehicles, landmarks, missing count, temperature."""
    df = feat.build_features(obs(spark, sf), profile="compact")
    return round_doubles(df)


@register("period_split", with_obs("""
SELECT idx, CASE WHEN day <= 20 THEN 'reference' ELSE 'target' END AS period FROM obs"""))
def q_period_split(spark, sf):
    from demandflow.sources.observations import split_periods
    ref, tgt = split_periods(obs(spark, sf))
    return (ref.select("idx", F.lit("reference").alias("period"))
            .unionByName(tgt.select("idx", F.lit("target").alias("period"))))
