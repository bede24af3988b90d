"""Template-and-trend forecasting from a reference period.

``reference`` plays the previous day, ``target`` the day being forecast.
Every template is an aggregate keyed by (geohash, slot) or (road, slot) and
is joined back with left joins; the trend table is keyed by geohash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.functions.categorical import sentinel
from demandflow.functions.numeric import clip
from demandflow.operators.order import exact_quantiles, rolling_mean
from demandflow.session import materialize


@dataclass
class Templates:
    exact_rolling: DataFrame  # geohash, slot, d48_lag_demand, d48_rolling_mean
    road: DataFrame           # road, slot, d48_road_demand
    trend: DataFrame          # geohash, trend_multiplier, trend_offset
    global_ratio: DataFrame   # one row: global_trend_ratio


def template_exact(ref: DataFrame) -> DataFrame:
    """Mean by (geohash, slot) -- the previous-period lag."""
    return ref.where(F.col("geohash").isNotNull()).groupBy("geohash", "slot") \
        .agg(F.avg("demand").alias("d48_lag_demand"))


def template_road(ref: DataFrame) -> DataFrame:
    """Mean by (road or MISSING, slot)."""
    return ref.withColumn("road", sentinel("road_type")).groupBy("road", "slot") \
        .agg(F.avg("demand").alias("d48_road_demand"))


def template_rolling(ref: DataFrame, chunk_rows: int | None = 1 << 20) -> DataFrame:
    """T3 (W1): 5-row centred rolling mean per geohash in (slot, idx) order, then one
    row per (geohash, slot) (mean of the row values; identical on unique keys)."""
    rolled = rolling_mean(ref.where(F.col("geohash").isNotNull()).select("geohash", "slot", "idx", "demand"),
                          "demand", ["geohash"], ["slot", "idx"], 2, "_roll", chunk_rows=chunk_rows)
    return rolled.groupBy("geohash", "slot").agg(F.avg("_roll").alias("d48_rolling_mean"))


def templates_joined(ref: DataFrame, chunk_rows: int | None = 1 << 20) -> DataFrame:
    """Exact and rolling templates, full outer join on (geohash, slot)."""
    return template_exact(ref).join(template_rolling(ref, chunk_rows), ["geohash", "slot"], "full")


def trend(ref: DataFrame, tgt: DataFrame, early_slot: int = 8) -> tuple[DataFrame, DataFrame]:
    """T4: early-slot means per geohash in both periods; ratio (0 denominators ->
    null), offset, median global ratio; the table's ratio is filled with the
    global ratio then clipped to [0.1, 10]."""
    e48 = ref.where((F.col("slot") <= early_slot) & F.col("geohash").isNotNull()).groupBy("geohash") \
        .agg(F.avg("demand").alias("early_d48_mean"))
    e49 = tgt.where((F.col("slot") <= early_slot) & F.col("geohash").isNotNull()).groupBy("geohash") \
        .agg(F.avg("demand").alias("early_d49_mean"))
    t = e48.join(e49, "geohash", "left")
    ratio = F.col("early_d49_mean") / F.nullif(F.col("early_d48_mean"), F.lit(0.0))
    # one row per geohash, read by the median pass and by the table: persist once
    t = materialize(t.withColumn("_ratio", ratio), "trend")
    g = exact_quantiles(t, "_ratio", [0.5]).select(F.col("_ratio").alias("global_trend_ratio"))
    g = t.limit(0).select(F.lit(None).cast("double").alias("global_trend_ratio")).unionByName(g) \
        .agg(F.max("global_trend_ratio").alias("global_trend_ratio"))  # always one row
    t = t.crossJoin(F.broadcast(g)).select(
        "geohash", "early_d48_mean", "early_d49_mean",
        clip(F.coalesce(F.col("_ratio"), F.col("global_trend_ratio")), 0.1, 10.0).alias("trend_multiplier"),
        F.coalesce(F.col("early_d49_mean") - F.col("early_d48_mean"), F.lit(0.0)).alias("trend_offset"))
    return t, g


def fit_templates(ref: DataFrame, tgt: DataFrame, chunk_rows: int | None = 1 << 20) -> Templates:
    t, g = trend(ref, tgt)
    return Templates(templates_joined(ref, chunk_rows), template_road(ref), t, g)


def ts_features(rows: DataFrame, tpl: Templates) -> DataFrame:
    """T5: fallback chain (exact -> road; rolling -> road; ratio -> unclipped global)
    and the heuristic forecast ``rolling * multiplier`` (T6)."""
    df = rows.withColumn("road", sentinel("road_type"))
    df = df.join(tpl.exact_rolling, ["geohash", "slot"], "left")
    df = df.join(tpl.road, ["road", "slot"], "left")
    df = df.join(tpl.trend.select("geohash", "trend_multiplier", "trend_offset"), "geohash", "left")
    df = df.crossJoin(F.broadcast(tpl.global_ratio))
    df = df.withColumns({
        "trend_multiplier": F.coalesce(F.col("trend_multiplier"), F.col("global_trend_ratio")),
        "trend_offset": F.coalesce(F.col("trend_offset"), F.lit(0.0)),
        "d48_lag_demand": F.coalesce(F.col("d48_lag_demand"), F.col("d48_road_demand")),
        "d48_rolling_mean": F.coalesce(F.col("d48_rolling_mean"), F.col("d48_road_demand")),
    })
    df = df.withColumn("heuristic_demand", F.col("d48_rolling_mean") * F.col("trend_multiplier"))
    return df.drop("global_trend_ratio")


TS_FEATURES = ["d48_lag_demand", "d48_rolling_mean", "d48_road_demand", "trend_multiplier", "trend_offset",
               "heuristic_demand", "number_of_lanes", "slot"]
