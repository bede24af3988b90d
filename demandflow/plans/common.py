"""Shared pieces of the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.functions.time import hour_of, minute_of, slot_of
from demandflow.sources.observations import observations


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


def obs_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs + hour, minute, slot."""
    return obs(spark, sf_dir).withColumns(
        {"hour": hour_of("timestamp"), "minute": minute_of("timestamp"), "slot": slot_of("timestamp")})


def ref_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("day") <= 20)


def tgt_of(df: DataFrame) -> DataFrame:
    return df.where(F.col("day") > 20)
