"""The observation table ``obs`` (one row per place x day x quarter-hour reading).

The reference reads ``train.csv``/``test.csv`` with columns ``Index, geohash,
day, timestamp, RoadType, NumberofLanes, LargeVehicles, Landmarks,
Temperature, Weather, demand``.  The driver ships no such file, so ``obs`` is
a pure projection of the ``events`` table with the same schema (snake case).
The mapping is a fixed rule (see FIXTURES.md section 3): it only shapes rows,
none of the operators rely on how it is built.

Scale notes: the projection is one narrow ``Project`` over the parquet scan
(only the columns a query uses are read); filters on ``day``/``idx`` run in
the scan's stage, before any exchange.  Stored as a table partitioned by day,
the period filters would also prune files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.functions.categorical import sentinel
from demandflow.functions.time import hour_of, slot_of

OBS_COLUMNS = ["idx", "geohash", "day", "timestamp", "demand", "road_type",
               "number_of_lanes", "large_vehicles", "landmarks", "temperature", "weather"]

# The period boundary standing in for "day 48 -> day 49".
REFERENCE_LAST_DAY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def observations_from_events(events: DataFrame) -> DataFrame:
    ts = F.col("ts")
    k = F.regexp_extract(F.col("props"), r"([0-9]+)", 1).cast("int")
    minute15 = (F.floor(F.minute(ts) / 15) * 15).cast("int")
    return events.select(
        F.col("event_id").alias("idx"),
        F.translate(F.substring(F.md5(F.col("user_id").cast("string")), 1, 6), "a", "g").alias("geohash"),
        F.dayofmonth(ts).cast("int").alias("day"),
        F.concat(F.hour(ts).cast("int").cast("string"), F.lit(":"), minute15.cast("string")).alias("timestamp"),
        (F.col("value") / F.lit(500)).alias("demand"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
         .when(k % 3 == 0, F.lit("Residential"))
         .when(k % 3 == 1, F.lit("Commercial"))
         .otherwise(F.lit("Highway")).alias("road_type"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
         .otherwise((F.lit(1) + k % 5).cast("double")).alias("number_of_lanes"),
        F.when(k % 2 == 0, F.lit("Allowed")).otherwise(F.lit("Not Allowed")).alias("large_vehicles"),
        F.when(k % 7 == 0, F.lit("Yes")).otherwise(F.lit("No")).alias("landmarks"),
        F.when(k % 13 == 0, F.lit(None).cast("double"))
         .otherwise(k * F.lit(0.5) - F.lit(5.0)).alias("temperature"),
        F.when(F.col("event_type") == "view", F.lit("Sunny"))
         .when(F.col("event_type") == "click", F.lit("Cloudy"))
         .when(F.col("event_type") == "purchase", F.lit("Rainy"))
         .when(F.col("event_type") == "signup", F.lit("Snowy"))
         .otherwise(F.lit(None).cast("string")).alias("weather"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``obs`` view of ``events`` under ``sf_dir``."""
    return observations_from_events(table(spark, sf_dir, "events"))


def reference_period(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("day") <= REFERENCE_LAST_DAY)


def target_period(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("day") > REFERENCE_LAST_DAY)


def split_periods(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reference period, target period)."""
    return reference_period(obs), target_period(obs)


def lookup_samples(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): every 5th id stands for the unlabelled test rows, all other rows are labelled."""
    return obs.where(F.col("idx") % 5 != 0), obs.where(F.col("idx") % 5 == 0)


def base_predictions(obs: DataFrame, materialize: bool = False) -> DataFrame:
    """Three deterministic predictors fitted on the reference period, applied to
    the target period: ``pa`` smoothed geohash encoding (alpha 10), ``pb`` mean by
    (road or MISSING, slot), ``pc`` mean by (geohash, hour); unseen -> global mean.

    Output ``idx, demand, pa, pb, pc``.  Stands in for k models' out-of-fold
    predictions in the blending operators.
    """
    from demandflow.operators.encoders import apply_mean, fit_many
    from demandflow.session import materialize as write_back

    ref, tgt = split_periods(obs)
    extra = {"road_key": sentinel("road_type"), "slot": slot_of("timestamp"), "hour": hour_of("timestamp")}
    ref, tgt = ref.withColumns(extra), tgt.withColumns(extra)
    # the three tables share one GROUPING SETS pass, written once
    means = fit_many(ref, {"pa": ["geohash"], "pb": ["road_key", "slot"], "pc": ["geohash", "hour"]}, "demand",
                     alpha={"pa": 10.0}, store=True)
    out = apply_mean(tgt, means["pa"], ["geohash"], "pa")
    out = apply_mean(out, means["pb"], ["road_key", "slot"], "pb")
    out = apply_mean(out, means["pc"], ["geohash", "hour"], "pc")
    out = out.select("idx", "demand", "pa", "pb", "pc")
    # several passes read it (ranks, moments, maps): cut the lineage once
    if materialize:
        return write_back(out, "base-predictions")
    return out
