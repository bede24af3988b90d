"""Feature operators that need an aggregate (medians, ranges, shortest key).

Frame statistics follow the reference's per-frame rule by default
(``fit_scope='frame'``: each frame uses its own median / min / max); pass a
fitting frame to :func:`fit_imputer` for the sound train-only variant.
Every statistic is a one-row aggregate attached with a broadcast cross join
(one row: a proven size bound).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.functions import categorical as cat
from demandflow.functions import geo, numeric, time
from demandflow.operators.order import median_row


def geohash_parts(df: DataFrame, gh: str = "geohash") -> DataFrame:
    """F7 with the reference's rule: characters 0..min(6, shortest length)-1."""
    shortest = df.agg(F.min(F.length(gh)).alias("m")).first()["m"] or 0  # one number
    return geo.geohash_parts(df, int(shortest), gh)


def median_fill(df: DataFrame, cols: list[str], suffix: str = "_filled") -> DataFrame:
    """``<col>_filled`` = col, or the frame's exact median when null."""
    med = median_row(df, cols, "_med")
    joined = df.crossJoin(F.broadcast(med))
    return joined.withColumns({c + suffix: F.coalesce(F.col(c).cast("double"), F.col(c + "_med"))
                               for c in cols}).drop(*[c + "_med" for c in cols])


def equal_width_bins(df: DataFrame, col: str, bins: dict[str, int]) -> DataFrame:
    """``pd.cut(x, bins=n, labels=False)``: right-closed equal-width bins over the
    frame's [min, max]; bin = number of interior edges strictly below x.  A constant
    column puts every value in the middle bin."""
    rng = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.crossJoin(F.broadcast(rng))
    x, mn, mx = F.col(col), F.col("_mn"), F.col("_mx")
    out = {}
    for name, n in bins.items():
        step = (mx - mn) / F.lit(n)
        total = None
        for i in range(1, n):
            t = (x > mn + F.lit(i) * step).cast("int")
            total = t if total is None else total + t
        out[name] = F.when(x.isNull(), F.lit(None).cast("int")).when(mx == mn, F.lit((n - 1) // 2)).otherwise(total if total is not None else F.lit(0))
    return j.withColumns(out).drop("_mn", "_mx")


def fit_imputer(df: DataFrame, cols: list[str]) -> DataFrame:
    """F22 fit: one row of exact medians (``SimpleImputer('median')``)."""
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return median_row(casted, cols, "_med")


def apply_imputer(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(fitted))
    return j.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(c + "_med")) for c in cols}) \
            .drop(*[c + "_med" for c in cols])


# named feature profiles.  "compact" keeps the short list the later
# stages of the reference settle on; "full" keeps everything engineered.
COMPACT_COLUMNS = ["idx", "hour", "minute", "geohash_prefix_5", "number_of_lanes", "road_type_encoded", "road_type_missing",
                   "large_vehicles_encoded", "landmarks_encoded", "n_missing", "hour_x_lv", "temperature_filled",
                   "temp_abs_from_25", "lat", "lon"]  # and geohash_char_0.. up to the shortest geohash


def build_features(df: DataFrame, profile: str = "full") -> DataFrame:
    """All scalar features (F1-F13) in one projection chain; ``profile`` picks the set."""
    out = time.all_time_features(df)
    out = cat.ordinal_encode(out)
    out = cat.missing_flags(out)
    out = median_fill(out, ["temperature", "number_of_lanes"])
    if profile == "compact":
        out = geo.geohash_decode(geohash_parts(out)).withColumns({
            "hour_x_lv": F.col("hour") * F.coalesce("large_vehicles_encoded", F.lit(0)),
            "temp_abs_from_25": F.abs(F.col("temperature_filled") - F.lit(25.0))})
        return out.select(*COMPACT_COLUMNS, *[c for c in out.columns if c.startswith("geohash_char_")])
    out = equal_width_bins(out, "temperature_filled", {"temp_bin_5": 5, "temp_bin_10": 10})
    out = numeric.threshold_features(out)
    out = numeric.interactions(out)
    return geohash_parts(out)
