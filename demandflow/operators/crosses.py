"""Crosses of features chosen by the data.

The gain of a pair is what its cells explain of the target beyond the better one of its two columns, both as epsilon
squared (the share of variance explained, adjusted for the number of cells, so that columns of many levels do not win by
chance).  All pairs and single columns come from one ``GROUPING SETS`` aggregate of counts, sums and sums of squares over one scan; the
cells are combined before the shuffle and never joined back.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators.lookup import exact


def cell_sums(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """gid (which of the grouping sets), _n, _s: rows and sum of the target in every cell of every pair and column.

    Columns are taken as text; a missing level is a level ('')."""
    sets = [(c,) for c in columns] + list(itertools.combinations(columns, 2))
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns], exact(target).alias("_y")).where("_y is not null")
    cells = named.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id(*columns).alias("gid"), F.count(F.lit(1)).alias("_n"), F.sum("_y").cast("double").alias("_s"))
    return cells.select("gid", "_n", "_s")


def _gid(columns: list[str], chosen) -> int:
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in chosen)


def pair_gains(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """a, b, cells, eps2_a, eps2_b, eps2_pair, gain of every pair of columns."""
    total = df.where(exact(target).isNotNull()).agg(F.count(F.lit(1)).alias("_N"), F.sum(exact(target)).cast("double").alias("_S"), F.var_pop(exact(target).cast("double")).alias("_V"))
    sums = cell_sums(df, columns, target).groupBy("gid").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_between"))
    e = sums.crossJoin(F.broadcast(total))  # one row
    n, sst = F.col("_N"), F.col("_V") * F.col("_N")
    ssw = sst - (F.col("_between") - F.col("_S") * F.col("_S") / n)
    eps = F.when((sst > 0) & (n > F.col("cells")), F.lit(1.0) - (ssw / (n - F.col("cells"))) / (sst / (n - 1)))
    e = e.select("gid", "cells", eps.alias("eps2"))
    pairs = [(a, b, _gid(columns, (a, b)), _gid(columns, (a,)), _gid(columns, (b,))) for a, b in itertools.combinations(columns, 2)]
    out = df.sparkSession.createDataFrame(pairs, "a string, b string, _p int, _a int, _b int")  # bounded by the number of columns
    for side in ("p", "a", "b"):
        one = e.select(F.col("gid").cast("int").alias(f"_{side}"), F.col("eps2").alias(f"_e{side}"), F.col("cells").alias(f"_c{side}"))
        out = out.join(one, f"_{side}", "left")
    return out.select("a", "b", F.col("_cp").alias("cells"), F.col("_ea").alias("eps2_a"), F.col("_eb").alias("eps2_b"), F.col("_ep").alias("eps2_pair"),
                      (F.col("_ep") - F.greatest("_ea", "_eb")).alias("gain"))
