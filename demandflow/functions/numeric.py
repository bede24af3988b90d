"""Numeric scalar helpers: thresholds, interactions, target transform, clipping, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def r6(col) -> Column:
    """Round to 6 decimals the same way in every engine: ``round(x*1e6)/1e6 + 0.0``.

    Rounding the scaled value to an integer decides ties on the binary value
    (identical in Spark and DuckDB); ``+ 0.0`` turns ``-0.0`` into ``0.0``.
    """
    return F.round(_c(col).cast("double") * F.lit(1e6), 0) / F.lit(1e6) + F.lit(0.0)


def round_doubles(df: DataFrame) -> DataFrame:
    """Apply :func:`r6` to every double/float column (report boundary only)."""
    return df.select([r6(f.name).alias(f.name) if f.dataType.typeName() in ("double", "float")
                      else F.col(f.name) for f in df.schema.fields])


def clip(col, lo: float | None = 0.0, hi: float | None = 1.0) -> Column:
    """clip with null/NaN pass-through (unlike ``greatest``/``least``)."""
    x = _c(col)
    out = x
    if hi is not None:
        out = F.when(x > F.lit(hi), F.lit(hi)).otherwise(out)
    if lo is not None:
        out = F.when(x < F.lit(lo), F.lit(lo)).otherwise(out)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(out)


def log_target(col) -> Column:
    """F19 forward transform."""
    return F.log1p(_c(col))


def exp_target(col) -> Column:
    """F19 inverse transform."""
    return F.expm1(_c(col))


def threshold_features(df: DataFrame, temp: str = "temperature_filled",
                       lanes: str = "number_of_lanes_filled") -> DataFrame:
    """cold < 10, hot > 35, |T - 25|, lanes >= 3."""
    t = F.col(temp)
    return df.withColumns({
        "is_cold": (t < 10).cast("int"),
        "is_hot": (t > 35).cast("int"),
        "temp_abs_from_25": F.abs(t - F.lit(25.0)),
        "is_multilane": (F.col(lanes) >= 3).cast("int"),
    })


def _d(col, default) -> Column:
    return F.coalesce(_c(col).cast("double"), F.lit(float(default)))


def interactions(df: DataFrame) -> DataFrame:
    """the nine numeric interactions with per-term null defaults.

    Needs the time flags, the ordinal codes and the filled temperature/lanes.
    ``+ 0.0`` normalises ``-0.0`` produced by ``0 * -1``.
    """
    rush = F.col("is_rush_hour").cast("double")
    hour = F.col("hour").cast("double")
    temp = F.col("temperature_filled")
    lanes = F.col("number_of_lanes_filled")
    z = F.lit(0.0)
    return df.withColumns({
        "rush_x_roadtype": rush * _d("road_type_encoded", -1) + z,
        "night_x_temp": F.col("is_night").cast("double") * temp + z,
        "weekend_x_hour": F.col("is_weekend").cast("double") * hour + z,
        "rush_x_lanes": rush * lanes + z,
        "weather_x_hour": _d("weather_encoded", -1) * hour + z,
        "landmarks_x_rush": _d("landmarks_encoded", 0) * rush + z,
        "lv_x_lanes": _d("large_vehicles_encoded", 0) * lanes + z,
        "temp_x_weather": temp * _d("weather_encoded", 0) + z,
        "hour_x_lv": hour * _d("large_vehicles_encoded", 0) + z,
    })


def interactions_ext(df: DataFrame) -> DataFrame:
    """second interaction set; every categorical code defaults to -1 when null.

    Uses the filled temperature / lane columns like the first set.
    """
    z = F.lit(0.0)
    hour = F.col("hour").cast("double")
    temp = F.col("temperature_filled")
    lanes = F.col("number_of_lanes_filled")
    return df.withColumns({
        "rt_x_lanes": _d("road_type_encoded", -1) * lanes + z,
        "weather_x_hour_num": _d("weather_encoded", -1) * hour + z,
        "weather_x_temp": _d("weather_encoded", -1) * temp + z,
        "lv_x_lanes_num": _d("large_vehicles_encoded", -1) * lanes + z,
        "rush_x_rt_num": F.col("is_rush_hour").cast("double") * _d("road_type_encoded", -1) + z,
        "temp_x_hour": temp * hour + z,
    })
