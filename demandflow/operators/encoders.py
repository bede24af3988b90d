"""Fitted encoders: ``fit_*`` aggregates over an explicit fitting frame (pass
``df.where(period)`` -- E11), ``apply_*`` joins the fitted table back.

Fitted tables are ``keys..., value`` plus a one-row default frame.  The
default frame has a proven size (one row) and is broadcast; the keyed table
is left un-hinted so AQE picks broadcast-hash only when its *measured* size
is under the threshold and falls back to a shuffle join otherwise (a
geohash table grows with the data).  Null keys never match (pandas
``groupby`` drops them; SQL equi-joins do not match null).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.functions.categorical import ORDINAL_MAPS, text_or_nan
from demandflow.operators.order import exact_quantiles, global_row_number
from demandflow.session import materialize


@dataclass
class Fitted:
    table: DataFrame        # keys..., value
    default: DataFrame      # one row: value for unseen/null keys
    keys: list
    value: str = "value"


def _nonnull(df: DataFrame, keys) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def _apply(df: DataFrame, fitted: Fitted, keys, out: str) -> DataFrame:
    t = fitted.table.withColumnRenamed(fitted.value, "_enc")
    d = fitted.default.select(F.col(fitted.default.columns[0]).alias("_dflt"))
    joined = df.join(t, on=list(keys), how="left").crossJoin(F.broadcast(d))
    return joined.withColumn(out, F.coalesce(F.col("_enc"), F.col("_dflt"))).drop("_enc", "_dflt")


# --- E2 mean -----------------------------------------------------------------
def fit_mean(df: DataFrame, keys, target: str) -> Fitted:
    keys = list(keys)
    table = _nonnull(df, keys).groupBy(*keys).agg(F.avg(target).alias("value"))
    return Fitted(table, df.agg(F.avg(target).alias("default")), keys)


def apply_mean(df: DataFrame, fitted: Fitted, keys, out: str) -> DataFrame:
    return _apply(df, fitted, keys, out)


# --- E3 median -----------------------------------------------------------------
def fit_median(df: DataFrame, keys, target: str) -> Fitted:
    """Exact group medians through the bucketed position operator (a hot key is
    split over value buckets rather than merged in one task)."""
    keys = list(keys)
    q = exact_quantiles(_nonnull(df, keys), target, [0.5], by=keys)
    table = q.select(*keys, F.col(target).alias("value"))
    g = exact_quantiles(df, target, [0.5]).select(F.col(target).alias("default"))
    return Fitted(table, g, keys)


# --- E4 smoothed -----------------------------------------------------------------
def fit_smoothed(df: DataFrame, keys, target: str, alpha: float = 10.0) -> Fitted:
    """``(mean*n + g*alpha) / (n + alpha)`` with g the frame mean; unseen -> g."""
    keys = list(keys)
    g = df.agg(F.avg(target).alias("default"))
    stats = _nonnull(df, keys).groupBy(*keys).agg(F.avg(target).alias("_m"), F.count(target).alias("_n"))
    a = F.lit(float(alpha))
    table = stats.crossJoin(F.broadcast(g)).select(
        *keys, ((F.col("_m") * F.col("_n") + F.col("default") * a) / (F.col("_n") + a)).alias("value"))
    return Fitted(table, g, keys)


def apply_smoothed(df: DataFrame, fitted: Fitted, keys, out: str) -> DataFrame:
    return _apply(df, fitted, keys, out)


def fit_smoothed_many(df: DataFrame, columns: list[str], target: str, alpha: float = 10.0) -> DataFrame:
    """E4 for many columns in **one** aggregation pass (``GROUPING SETS``):
    returns ``column, key (as text), value``; apply with :func:`apply_long`."""
    stats = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(
        F.avg(target).alias("m"), F.count(target).alias("n"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    which = None
    for c in reversed(columns):
        which = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(which if which is not None else F.lit(None))
    key = F.coalesce(*[F.col(c).cast("string") for c in columns])
    stats = stats.select(which.alias("column"), key.alias("key"), "m", "n").where(F.col("key").isNotNull())
    g = df.agg(F.avg(target).alias("g"))
    a = F.lit(float(alpha))
    return stats.crossJoin(F.broadcast(g)).select(
        "column", "key", ((F.col("m") * F.col("n") + F.col("g") * a) / (F.col("n") + a)).alias("value"))


# --- E5 composite ----------------------------------------------------------------
def fit_composite_mean(df: DataFrame, keys, target: str) -> Fitted:
    return fit_mean(df, keys, target)


# --- E6 frequency ------------------------------------------------------------------
def fit_frequency(df: DataFrame, col: str) -> Fitted:
    """Share among non-null rows; unseen / null -> 0."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    total = df.agg(F.count(col).alias("_t"))
    table = counts.crossJoin(F.broadcast(total)).select(col, (F.col("_c") / F.col("_t")).alias("value"))
    zero = df.sparkSession.range(1).select(F.lit(0.0).alias("default"))
    return Fitted(table, zero, [col])


def apply_frequency(df: DataFrame, fitted: Fitted, col: str, out: str) -> DataFrame:
    return _apply(df, fitted, [col], out)


# --- E7 level mix ------------------------------------------------------------------
def fit_level_mix(df: DataFrame, key: str, col: str, levels: dict | None = None,
                  prefix: str = "geo_weather") -> DataFrame:
    """Share of each level of ``col`` per ``key`` (one-hot then mean; a null level
    counts in the denominator only).  Levels are the fixed code set of ``col``; any
    other level counts in ``<prefix>_other``."""
    levels = levels or ORDINAL_MAPS[col]
    aggs = [F.avg(F.when(F.col(col) == F.lit(name), F.lit(1.0)).otherwise(F.lit(0.0)))
            .alias(f"{prefix}_{code}") for name, code in sorted(levels.items(), key=lambda kv: kv[1])]
    other = F.col(col).isNotNull() & ~F.col(col).isin(list(levels))
    aggs.append(F.avg(F.when(other, F.lit(1.0)).otherwise(F.lit(0.0))).alias(f"{prefix}_other"))
    return _nonnull(df, [key]).groupBy(key).agg(*aggs)


def observed_level_mix(df: DataFrame, key: str, col: str, prefix: str) -> DataFrame:
    """F21 + E7: one-hot by the levels that are observed, then the mean per ``key``: columns ``<prefix>_<level>``.

    A missing level counts in the denominator only.  Levels come from one aggregate (Spark's pivot refuses more than
    ``spark.sql.pivotMaxValues``), shares from counts per (key, level)."""
    per = _nonnull(df, [key]).groupBy(key, col).agg(F.count(F.lit(1)).alias("_c"))
    levels = [r[0] for r in per.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).limit(
        int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000")) + 1).collect()]
    wide = per.groupBy(key).pivot(col, levels).agg(F.sum("_c")) if levels else per.select(key).distinct()
    total = per.groupBy(F.col(key).alias("_k")).agg(F.sum("_c").alias("_n"))
    j = wide.join(total, F.col(key) == F.col("_k"))
    return j.select(key, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) / F.col("_n")).alias(f"{prefix}_{v}") for v in levels])


# --- E8 / E9 stats -------------------------------------------------------------------
def fit_group_stats(df: DataFrame, key: str, value: str, prefix: str,
                    stats=("mean", "std", "min", "max"), std_null_as_zero: bool = False) -> DataFrame:
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = []
    for s in stats:
        e = fns[s](value)
        if s == "std" and std_null_as_zero:
            e = F.coalesce(e, F.lit(0.0))
        aggs.append(e.alias(f"{prefix}_{s}"))
    return _nonnull(df, [key]).groupBy(key).agg(*aggs)


def fit_stats_many(df: DataFrame, key: str, specs: list[tuple]) -> DataFrame:
    """Several E8 statistic sets over the same key in ONE aggregate.
    ``specs``: (value column, output prefix, stats, std_null_as_zero)."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = []
    for value, prefix, stats, zero in specs:
        for s in stats:
            e = fns[s](value)
            if s == "std" and zero:
                e = F.coalesce(e, F.lit(0.0))
            aggs.append(e.alias(f"{prefix}_{s}"))
    return _nonnull(df, [key]).groupBy(key).agg(*aggs)


def fit_group_count(df: DataFrame, key: str, out: str) -> DataFrame:
    return _nonnull(df, [key]).groupBy(key).agg(F.count(F.lit(1)).alias(out))


# --- E1 label encoding ----------------------------------------------------------------
def fit_label_codes(frames: list[DataFrame], col: str) -> DataFrame:
    """Codes 0.. in code-point order of the distinct texts of ``col`` over the union
    of ``frames``; null is the text ``nan``.  Distinct values are numbered with
    :func:`global_row_number` (no single-task window)."""
    vals = None
    for f in frames:
        v = f.select(text_or_nan(col).alias("_txt"))
        vals = v if vals is None else vals.unionByName(v)
    distinct = vals.distinct()
    numbered = global_row_number(distinct, ["_txt"], out="_rn")
    return numbered.select(F.col("_txt"), (F.col("_rn") - 1).cast("int").alias("code"))


def fit_label_codes_many(frames: list[DataFrame], cols: list[str]) -> DataFrame:
    """E1 for several columns with ONE distributed numbering: distinct
    ``(column, text)`` pairs are numbered in (column, text) order and each
    column's codes start at 0 (first number of the column subtracted).
    Returns ``column, _txt, code``."""
    vals = None
    for f in frames:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), text_or_nan(c).alias("_txt")) for c in cols])
        v = f.select(F.explode(pairs).alias("_p")).select("_p.*")
        vals = v if vals is None else vals.unionByName(v)
    numbered = global_row_number(vals.distinct(), ["column", "_txt"], out="_rn")
    starts = numbered.groupBy("column").agg(F.min("_rn").alias("_start"))  # one row per column
    return numbered.join(F.broadcast(starts), "column").select(
        "column", "_txt", (F.col("_rn") - F.col("_start")).cast("int").alias("code"))


def apply_label_codes_many(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "_le") -> DataFrame:
    out = df
    for c in cols:
        t = codes.where(F.col("column") == F.lit(c)).select(F.col("_txt").alias(f"_t_{c}"),
                                                           F.col("code").alias(c + suffix))
        out = out.join(t, text_or_nan(c) == F.col(f"_t_{c}"), "left").drop(f"_t_{c}")
    return out


def apply_label_codes(df: DataFrame, codes: DataFrame, col: str, out: str) -> DataFrame:
    keyed = df.withColumn("_txt", text_or_nan(col))
    return keyed.join(codes.withColumnRenamed("code", out), on="_txt", how="left").drop("_txt")




def apply_long(df: DataFrame, long: DataFrame, columns: list[str], default: DataFrame,
               prefix: str = "te_") -> DataFrame:
    """Apply a long ``column, key, value`` encoding table (from
    :func:`fit_smoothed_many`) to ``df``: one left join per encoded column on its
    text key, unseen -> the one-row ``default``."""
    d = default.select(F.col(default.columns[0]).alias("_dflt"))
    out = df.crossJoin(F.broadcast(d))
    for c in columns:
        t = long.where(F.col("column") == F.lit(c)).select(F.col("key").alias(f"_k_{c}"),
                                                          F.col("value").alias(f"_v_{c}"))
        out = out.join(t, F.col(c).cast("string") == F.col(f"_k_{c}"), "left")
        out = out.withColumn(prefix + c, F.coalesce(F.col(f"_v_{c}"), F.col("_dflt"))).drop(f"_k_{c}", f"_v_{c}")
    return out.drop("_dflt")


def _gid(all_keys: list[str], keys: list[str]) -> int:
    n = len(all_keys)
    return sum((0 if k in keys else 1) << (n - 1 - i) for i, k in enumerate(all_keys))


def fit_many(df: DataFrame, key_sets: dict[str, list[str]], target: str,
             alpha: float | dict[str, float] | None = None, store: bool = False) -> dict[str, Fitted]:
    """E2/E4/E5 for several key sets in ONE aggregation pass.

    ``store`` writes the aggregate once, so that the tables do not each run the pass again; ``alpha`` may
    be given per key set.

    ``GROUPING SETS ((k1...), (k2...), ..., ())`` yields every per-key table and
    the global mean/count together; each Fitted reads its slice by
    ``grouping_id``.  ``alpha`` switches from plain means to smoothed means
    ``(mean*n + g*alpha) / (n + alpha)``.  Null keys are dropped per set.
    """
    all_keys: list[str] = []
    for ks in key_sets.values():
        for k in ks:
            if k not in all_keys:
                all_keys.append(k)
    sets = [[F.col(k) for k in ks] for ks in key_sets.values()] + [[]]
    stats = df.groupingSets(sets, *all_keys).agg(
        F.avg(target).alias("_m"), F.count(target).alias("_n"), F.grouping_id().alias("_gid"))
    if store:
        stats = materialize(stats, "grouping-sets")
    default = stats.where(F.col("_gid") == F.lit((1 << len(all_keys)) - 1)).select(F.col("_m").alias("default"))
    out = {}
    for name, ks in key_sets.items():
        part = _nonnull(stats.where(F.col("_gid") == F.lit(_gid(all_keys, ks))), ks)
        own = alpha.get(name) if isinstance(alpha, dict) else alpha
        if own is None:
            table = part.select(*ks, F.col("_m").alias("value"))
        else:
            a = F.lit(float(own))
            table = part.crossJoin(F.broadcast(default)).select(
                *ks, ((F.col("_m") * F.col("_n") + F.col("default") * a) / (F.col("_n") + a)).alias("value"))
        out[name] = Fitted(table, default, list(ks))
    return out
