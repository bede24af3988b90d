"""Categorical scalar helpers: fixed ordinal maps, missing flags, sentinels, crosses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordinal codes of the four categorical inputs (unknown/null -> null).
ROAD_TYPE_CODES = {"Residential": 0, "Commercial": 1, "Highway": 2}
LARGE_VEHICLES_CODES = {"Not Allowed": 0, "Allowed": 1}
LANDMARKS_CODES = {"No": 0, "Yes": 1}
WEATHER_CODES = {"Sunny": 0, "Cloudy": 1, "Rainy": 2, "Snowy": 3}

ORDINAL_MAPS = {
    "road_type": ROAD_TYPE_CODES,
    "large_vehicles": LARGE_VEHICLES_CODES,
    "landmarks": LANDMARKS_CODES,
    "weather": WEATHER_CODES,
}

# Columns whose nulls are flagged and counted in ``n_missing``.
MISSING_CHECK_COLUMNS = ["road_type", "temperature", "weather", "landmarks",
                         "large_vehicles", "number_of_lanes"]

# Fixed value: sentinel text for a null category.
MISSING_SENTINEL = "MISSING"


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def ordinal(col, mapping: dict) -> Column:
    """Literal map lookup; keys absent from the map (and null) give null."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return m[_c(col)].cast("int")


def ordinal_encode(df: DataFrame, maps: dict | None = None) -> DataFrame:
    """F8: ``<col>_encoded`` for each fixed ordinal map."""
    maps = maps or ORDINAL_MAPS
    return df.withColumns({f"{c}_encoded": ordinal(c, m) for c, m in maps.items()})


def missing_flags(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``<col>_missing`` (0/1) per column and ``n_missing`` per row."""
    cols = cols or MISSING_CHECK_COLUMNS
    flags = {f"{c}_missing": F.col(c).isNull().cast("int") for c in cols}
    total = None
    for c in cols:
        f = F.col(c).isNull().cast("int")
        total = f if total is None else total + f
    flags["n_missing"] = total
    return df.withColumns(flags)


def sentinel(col, value: str = MISSING_SENTINEL) -> Column:
    """null -> sentinel category."""
    return F.coalesce(_c(col), F.lit(value))


def text_or_nan(col) -> Column:
    """A value as text the way a pandas ``astype(str)`` shows it: null -> ``nan``."""
    return F.coalesce(_c(col).cast("string"), F.lit("nan"))


def category_cross(a, b) -> Column:
    """categorical cross ``a_b`` as text (null parts shown as ``nan``)."""
    return F.concat_ws("_", text_or_nan(a), text_or_nan(b))
