"""M1-M6: scores as single aggregates (no driver-side loops over rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.operators.order import value_positions


def r2_expr(y: str, p: str) -> Column:
    """Aggregate Column: R^2 with sklearn's constant-target rule.

    ``1 - SSE / SST`` with ``SST = var_pop(y) * n`` (a numerically stable
    one-pass form).  Constant target: 1.0 if perfect, else 0.0.  Rows with a
    null target or prediction are skipped.
    """
    both = F.col(y).isNotNull() & F.col(p).isNotNull()
    yy = F.when(both, F.col(y))
    pp = F.when(both, F.col(p))
    sse = F.sum((yy - pp) * (yy - pp))
    sst = F.var_pop(yy) * F.count(yy)
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) - sse / sst)


def score_expr(r2: Column) -> Column:
    """Competition score ``max(0, 100 * R^2)``."""
    return F.greatest(F.lit(0.0), F.lit(100.0) * r2)


def r2_score(df: DataFrame, y: str, p: str, by: list[str] | tuple = ()) -> DataFrame:
    """``by..., n, r2, score`` (one row per group, or one row)."""
    agg = [F.count(F.when(F.col(y).isNotNull() & F.col(p).isNotNull(), 1)).alias("n"), r2_expr(y, p).alias("r2")]
    out = df.groupBy(*by).agg(*agg) if by else df.agg(*agg)
    return out.withColumn("score", score_expr(F.col("r2")))


def fold_summary(df: DataFrame, y: str, p: str, fold: str = "fold") -> DataFrame:
    """M2 + A9: per-fold scores -> mean, population std, and the overall OOF score."""
    per_fold = r2_score(df, y, p, by=[fold])
    s = per_fold.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
                     F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"),
                     F.count(F.lit(1)).alias("n_folds"))
    overall = r2_score(df, y, p).select(F.col("r2").alias("oof_r2"), F.col("score").alias("oof_score"))
    return s.crossJoin(overall)


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | tuple = ()) -> DataFrame:
    """M3: exact ROC-AUC from average ranks (Mann-Whitney), ties counted half.

    ``AUC = (sum of positive ranks - n+(n+ + 1)/2) / (n+ n-)``.  The positive
    rank sum comes from the distinct-score position table, so nothing is
    joined back and no single-task window is used.
    """
    by = list(by)
    pos = value_positions(df.where(F.col(label).isNotNull()), score, by,
                          sums={"_npos": F.col(label).cast("long")})
    rank = F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    agg = [F.sum(rank * F.col("_npos")).alias("_rpos"), F.sum("_npos").alias("n_pos"),
           F.sum("cnt").alias("_n")]
    s = pos.groupBy(*by).agg(*agg) if by else pos.agg(*agg)
    npos = F.col("n_pos").cast("double")
    nneg = (F.col("_n") - F.col("n_pos")).cast("double")
    auc = (F.col("_rpos") - npos * (npos + 1) / 2) / (npos * nneg)
    return s.select(*by, F.col("n_pos"), (F.col("_n") - F.col("n_pos")).alias("n_neg"),
                    F.when((npos > 0) & (nneg > 0), auc).alias("auc"))


def variant_diff(a: Column, b: Column, big: float = 0.5, small: float = 0.1) -> Column:
    """M4: three-way verdict on a score difference ``a - b``."""
    d = a - b
    return (F.when(d > big, F.lit("better")).when(d < -big, F.lit("worse"))
             .when(F.abs(d) <= small, F.lit("same")).otherwise(F.lit("marginal")))
