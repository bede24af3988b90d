"""Time-of-day and day-number features over the text ``H:M`` timestamp.

The observation time is a text ``H:M`` (parts not necessarily zero padded)
plus an integer day number.  Division and modulo follow floor semantics
(``pmod``/``floor``) so negative inputs behave like Python's ``//``/``%``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def hour_of(ts) -> Column:
    return F.split(_c(ts), ":").getItem(0).cast("int")


def minute_of(ts) -> Column:
    return F.split(_c(ts), ":").getItem(1).cast("int")


def fdiv(x, d: int) -> Column:
    """Floor division by a positive integer constant, as an int."""
    return F.floor(_c(x) / F.lit(d)).cast("int")


def slot_of(ts) -> Column:
    """Quarter-hour slot 0..95 of an ``H:M`` text."""
    return hour_of(ts) * 4 + fdiv(minute_of(ts), 15)


def parse_time(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """``H:M`` -> ``hour``, ``minute`` (ints)."""
    return df.withColumns({"hour": hour_of(ts), "minute": minute_of(ts)})


def time_slots(df: DataFrame, hour: str = "hour", minute: str = "minute") -> DataFrame:
    """F2 + F5: quarter-hour, 30-minute and 2/3/4/6-hour buckets, minutes since midnight."""
    h, m = F.col(hour), F.col(minute)
    return df.withColumns({
        "quarter_hour": h * 4 + fdiv(m, 15),
        "time_bucket_30min": h * 2 + fdiv(m, 30),
        "time_bucket_2hr": fdiv(h, 2),
        "time_bucket_3hr": fdiv(h, 3),
        "time_bucket_4hr": fdiv(h, 4),
        "time_bucket_6hr": fdiv(h, 6),
        "minutes_since_midnight": h * 60 + m,
    })


def _between(h: Column, lo: int, hi: int) -> Column:
    return ((h >= lo) & (h <= hi)).cast("int")


def rush_flags(df: DataFrame, hour: str = "hour") -> DataFrame:
    """rush / night / business / peak indicator columns (0/1 ints)."""
    h = F.col(hour)
    morning = _between(h, 7, 9)
    evening = _between(h, 16, 19)
    return df.withColumns({
        "is_morning_rush": morning,
        "is_evening_rush": evening,
        "is_rush_hour": ((morning == 1) | (evening == 1)).cast("int"),
        "is_night": ((h >= 22) | (h <= 5)).cast("int"),
        "is_late_night": _between(h, 0, 4),
        "is_business_hours": _between(h, 9, 17),
        "is_peak_morning": _between(h, 8, 9),
        "is_peak_evening": _between(h, 17, 18),
    })


def _cyc(x: Column, period: int):
    a = F.lit(2 * math.pi) * x / F.lit(float(period))
    return F.sin(a), F.cos(a)


def cyclic_time(df: DataFrame, hour="hour", minute="minute", slot="quarter_hour",
                weekday: str | None = "day_of_week") -> DataFrame:
    """sin/cos of hour/24, minute/60, slot/96 and (optionally) weekday/7."""
    out = {}
    for name, col, period in [("hour", hour, 24), ("minute", minute, 60), ("quarter_hour", slot, 96)] + (
            [("day_of_week", weekday, 7)] if weekday else []):
        s, c = _cyc(F.col(col), period)
        out[f"{name}_sin"] = s
        out[f"{name}_cos"] = c
    return df.withColumns(out)


def day_features(df: DataFrame, day: str = "day") -> DataFrame:
    """weekday = day mod 7 (floor), weekend = {5, 6}, weekday flag, week = day div 7."""
    d = F.col(day)
    dow = F.pmod(d, F.lit(7))
    weekend = dow.isin(5, 6).cast("int")
    return df.withColumns({
        "day_of_week": dow,
        "is_weekend": weekend,
        "is_weekday": F.lit(1) - weekend,
        "week_number": fdiv(d, 7),
    })


def all_time_features(df: DataFrame, ts: str = "timestamp", day: str = "day") -> DataFrame:
    """F1-F6 in one projection (Catalyst collapses the chain into one Project)."""
    df = parse_time(df, ts)
    df = time_slots(df)
    df = rush_flags(df)
    df = day_features(df, day)
    return cyclic_time(df)
