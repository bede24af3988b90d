"""Profiling as single aggregates and small long-form reports.

Each report is computed in as few passes as possible: one ``agg`` with many
expressions over the scan, then a long-form reshape of that one row
(``unpivot``/``explode`` of a bounded struct array).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandflow.operators.order import average_rank, null_safe_join, plan_buckets, quantiles_wide


def round_dp(col, dp: int) -> Column:
    """Round to ``dp`` decimals, deciding ties on the binary value (engine independent)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * F.lit(10.0 ** dp), 0) / F.lit(10.0 ** dp) + F.lit(0.0)


def _long(row_df: DataFrame, items: list[tuple[str, dict[str, Column]]], key: str = "column") -> DataFrame:
    """Turn one wide row into long form: one output row per item."""
    structs = [F.struct(F.lit(name).alias(key), *[e.alias(k) for k, e in cols.items()]) for name, cols in items]
    return row_df.select(F.explode(F.array(*structs)).alias("_x")).select("_x.*")


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def column_types(df: DataFrame) -> DataFrame:
    """Column list with positions (from 1) and types; read from the schema, no pass over the rows."""
    return df.sparkSession.createDataFrame([(i + 1, c, t) for i, (c, t) in enumerate(df.dtypes)], "position int, column string, dtype string")


def missing_report(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count and percent (2 dp) per column; only columns with nulls."""
    cols = cols or df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = _long(row, [(c, {"missing_count": F.col(c), "_n": F.col("_n")}) for c in cols])
    return long.where(F.col("missing_count") > 0).select(
        "column", "missing_count", round_dp(F.col("missing_count") * 100.0 / F.col("_n"), 2).alias("missing_pct"))


def duplicate_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows beyond the first copy of each fully identical row."""
    cols = cols or df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once (all copies) with the copy count.
    Counts come from an aggregate (map-side combined), joined back on the key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)
    return null_safe_join(df, counts, keys).select(*keys, *[c for c in df.columns if c not in keys], "n_copies")


def cardinality(df: DataFrame, cols: list[str] | None = None, approx_rsd: float | None = None) -> DataFrame:
    """P5 / U4: distinct non-null values per column (``approx_rsd`` for HyperLogLog)."""
    cols = cols or df.columns
    fn = (lambda c: F.approx_count_distinct(c, approx_rsd)) if approx_rsd else F.countDistinct
    row = df.agg(*[fn(c).alias(c) for c in cols])
    return _long(row, [(c, {"n_unique": F.col(c)}) for c in cols])


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std (ddof 1), min, exact 25/50/75 %, max per column."""
    row = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
        F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"))])
    base = _long(row, [(c, {k: F.col(f"{c}__{k}") for k in ("count", "mean", "std", "min", "max")}) for c in cols])
    wide = quantiles_wide(df, cols, [0.25, 0.5, 0.75])
    qs = _long(wide, [(c, {"p25": F.col(f"{c}__q0"), "p50": F.col(f"{c}__q1"), "p75": F.col(f"{c}__q2")})
                      for c in cols])
    return base.join(qs, "column", "left")


def melt(df: DataFrame, cols: list[str], extra: list[str] | tuple = (), key: str = "column",
         value: str = "value") -> DataFrame:
    """Long form ``extra..., column, value`` (value as text) of several columns in one
    pass: reports over many columns then scan the table once instead of once per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).cast("string").alias(value)) for c in cols])
    return df.select(*extra, F.explode(pairs).alias("_kv")).select(*extra, f"_kv.{key}", f"_kv.{value}")


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Top-k value counts per column (nulls dropped; ties by value).

    One scan: the columns are melted, counted with map-side combine, and
    ``row_number() <= k`` lets Spark insert a per-partition group limit
    (WindowGroupLimit) before the final shuffle, so a column with millions of
    distinct values sends at most k rows per partition to the final sort.
    """
    vc = melt(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value") \
        .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shares(df: DataFrame, col: str) -> DataFrame:
    """Relative frequency among non-null rows."""
    total = df.agg(F.count(col).alias("_t"))
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c")) \
             .crossJoin(F.broadcast(total)).select(col, (F.col("_c") / F.col("_t")).alias("share"))


def distribution_compare(a: DataFrame, b: DataFrame, cols, names=("a", "b"), dp: int = 4) -> DataFrame:
    """Shares of each level in two samples side by side (a level missing from
    one sample has a null share there).  Both samples and all columns go through
    one melted count; per-column totals come from the same counts."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    u = a.select(*cols, F.lit(0).alias("_s")).unionByName(b.select(*cols, F.lit(1).alias("_s")))
    counts = melt(u, cols, extra=["_s"], value="level").where(F.col("level").isNotNull()) \
        .groupBy("column", "level").agg(*[F.count(F.when(F.col("_s") == i, 1)).alias(f"_c{i}") for i in (0, 1)])
    totals = counts.groupBy("column").agg(F.sum("_c0").alias("_t0"), F.sum("_c1").alias("_t1"))
    j = counts.join(totals, "column")  # one row per column
    share = [F.when(F.col(f"_c{i}") > 0, F.col(f"_c{i}") / F.col(f"_t{i}")) for i in (0, 1)]
    return j.select("column", "level", round_dp(share[0], dp).alias(f"share_{names[0]}"),
                    round_dp(share[1], dp).alias(f"share_{names[1]}"))


def histograms(df: DataFrame, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """P9 for several series in two passes total: one aggregate of every range,
    then one melted pass that bins and counts all series together."""
    names = list(specs)
    rng = df.agg(*[e for n in names for e in (F.min(F.col(specs[n][0]).cast("double")).alias(f"_mn_{n}"),
                                                F.max(F.col(specs[n][0]).cast("double")).alias(f"_mx_{n}"))])
    j = df.crossJoin(F.broadcast(rng))  # one row
    items = []
    for n in names:
        col, nb = specs[n]
        x, mn, mx = F.col(col).cast("double"), F.col(f"_mn_{n}"), F.col(f"_mx_{n}")
        b = F.when(mx == mn, F.lit(0)).otherwise(F.least(F.floor((x - mn) / (mx - mn) * F.lit(nb)), F.lit(nb - 1)))
        ok = x.isNotNull() & ~F.isnan(x)
        items.append(F.struct(F.lit(n).alias("series"), F.when(ok, b.cast("int")).alias("bin")))
    long = j.select(F.explode(F.array(*items)).alias("_h")).select("_h.*").where(F.col("bin").isNotNull())
    return long.groupBy("bin", "series").agg(F.count(F.lit(1)).alias("n"))


def missing_pattern(df: DataFrame, order: str, n: int = 500, cols: list[str] | None = None) -> DataFrame:
    """P10: null flags of the first ``n`` rows in ``order`` (a top-k: the limit is the feature)."""
    cols = cols or [c for c in df.columns if c != order]
    return df.orderBy(order).limit(n).select(order, *[F.col(c).isNull().cast("int").alias(f"{c}_isnull")
                                                     for c in cols])


def corr_long(df: DataFrame, cols: list[str], listwise: bool = True) -> DataFrame:
    """Pearson correlation of every pair (a < b in list order), one agg."""
    d = df.dropna(subset=cols) if listwise else df
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = d.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    return row.select(F.explode(F.array(*structs)).alias("_x")).select("_x.*")


def spearman_long(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Spearman = Pearson of average-tie ranks.  Each column is ranked
    independently with the distributed rank operator; the rank columns are
    joined on ``key``."""
    base = df.select(key, *cols)
    nb = plan_buckets(base, cols)
    ranked = None
    for c in cols:
        r = average_rank(base.select(key, c), c, out=f"_r_{c}", n_buckets=nb[c]).select(key, f"_r_{c}")
        ranked = r if ranked is None else ranked.join(r, key)
    renamed = ranked.select(key, *[F.col(f"_r_{c}").alias(c) for c in cols])
    return corr_long(renamed, cols, listwise=False)


def target_by_category(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Mean target per level (null level dropped), one melted pass."""
    m = melt(df, cols, extra=[target], value="level").where(F.col("level").isNotNull())
    return m.groupBy("column", "level").agg(F.avg(target).alias("mean_target"), F.count(F.lit(1)).alias("n"))


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Exact quartiles, IQR, strict outlier count and share, value range."""
    q = quantiles_wide(df.select(F.col(col).cast("double").alias("_x")), ["_x"], [0.25, 0.75],
                       {("_x", 0): "q1", ("_x", 1): "q3"})
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = df.select(F.col(col).cast("double").alias("_x")).crossJoin(F.broadcast(q))
    lo = F.col("q1") - F.lit(k) * F.col("iqr")
    hi = F.col("q3") + F.lit(k) * F.col("iqr")
    out = j.groupBy("q1", "q3", "iqr").agg(
        F.count(F.when((F.col("_x") < lo) | (F.col("_x") > hi), 1)).alias("n_outliers"),
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("min_value"), F.max("_x").alias("max_value"))
    return out.withColumn("outlier_pct", F.col("n_outliers") * 100.0 / F.col("_n")).drop("_n")


def id_leakage(train: DataFrame, test: DataFrame, key: str, target: str, threshold: float = 0.05) -> DataFrame:
    """Id ranges of both samples, corr(id, target), verdict ``|r| < threshold``."""
    a = train.agg(F.min(key).alias("train_min"), F.max(key).alias("train_max"),
                  F.corr(F.col(key).cast("double"), F.col(target)).alias("id_target_corr"))
    b = test.agg(F.min(key).alias("test_min"), F.max(key).alias("test_max"))
    return a.crossJoin(b).withColumn("non_informative", (F.abs("id_target_corr") < threshold).cast("int"))


