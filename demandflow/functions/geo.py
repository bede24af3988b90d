"""Geohash helpers as pure Column arithmetic (no UDF, no external library).

A geohash character carries 5 bits; bits alternate longitude / latitude
starting with longitude.  Every bit halves the current interval, so the lower
edge of the cell is the sum of the interval widths of the set bits, and the
decoded point is the cell centre.  All terms are dyadic rationals, so the
double result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The standard geohash base-32 alphabet, in code order.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
# Longest geohash decoded (standard maximum precision).
MAX_GEOHASH_LEN = 12


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def geohash_char(gh, i: int) -> Column:
    return F.substring(_c(gh), i + 1, 1)


def geohash_prefix(gh, n: int) -> Column:
    return F.substring(_c(gh), 1, n)


def geohash_parts(df: DataFrame, n_chars: int, gh: str = "geohash") -> DataFrame:
    """``geohash_char_{i}`` for i < min(6, n_chars) and prefixes of 3/4/5."""
    cols = {f"geohash_char_{i}": geohash_char(gh, i) for i in range(min(6, n_chars))}
    for n in (3, 4, 5):
        cols[f"geohash_prefix_{n}"] = geohash_prefix(gh, n)
    return df.withColumns(cols)


def _digit(gh: Column, i: int) -> Column:
    return F.instr(F.lit(GEOHASH_ALPHABET), F.substring(gh, i + 1, 1)) - 1


def geohash_decode_cols(gh, max_len: int = MAX_GEOHASH_LEN) -> tuple[Column, Column]:
    """(lat, lon) cell centre; null geohash -> (0, 0); a bad character -> null."""
    g = _c(gh)
    n = F.least(F.length(g), F.lit(max_len))
    lat_lo = F.lit(-90.0)
    lon_lo = F.lit(-180.0)
    bad = F.lit(False)
    j = 0
    lat_k = lon_k = 0
    for i in range(max_len):
        d = _digit(g, i)
        present = n > i
        bad = bad | (present & (d < 0))
        for k in range(5):
            bit = F.pmod(F.floor(d / F.lit(2 ** (4 - k))), F.lit(2))
            on = F.when(present & (d >= 0), bit).otherwise(F.lit(0))
            if j % 2 == 0:
                lon_lo = lon_lo + on * F.lit(360.0 / 2 ** (lon_k + 1))
                lon_k += 1
            else:
                lat_lo = lat_lo + on * F.lit(180.0 / 2 ** (lat_k + 1))
                lat_k += 1
            j += 1
    n_lon = F.floor((n * 5 + 1) / 2)
    n_lat = F.floor(n * 5 / 2)
    lat = lat_lo + F.lit(90.0) / F.pow(F.lit(2.0), n_lat)
    lon = lon_lo + F.lit(180.0) / F.pow(F.lit(2.0), n_lon)
    lat = F.when(g.isNull(), F.lit(0.0)).when(bad, F.lit(None)).otherwise(lat)
    lon = F.when(g.isNull(), F.lit(0.0)).when(bad, F.lit(None)).otherwise(lon)
    return lat, lon


def geohash_decode(df: DataFrame, gh: str = "geohash", lat: str = "lat", lon: str = "lon") -> DataFrame:
    la, lo = geohash_decode_cols(gh)
    return df.withColumns({lat: la, lon: lo})
