"""Feature importance tables and their rank merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def desc_average_rank(table: DataFrame, score: str, out: str) -> DataFrame:
    """Descending average-tie rank over a small table (one row per feature:
    bounded by the feature count, so an un-partitioned window is fine)."""
    w = Window.orderBy(F.col(score).desc())
    ties = Window.partitionBy(score)
    return table.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def rank_merge(tables: dict[str, DataFrame], feature: str = "feature") -> DataFrame:
    """I4 + J5: inner-join importance tables on the feature name, rank each
    (descending, average ties) and order by the mean rank."""
    merged = None
    names = []
    for name, t in tables.items():
        r = desc_average_rank(t.select(feature, F.col(t.columns[1]).alias(name)), name, f"rank_{name}")
        merged = r if merged is None else merged.join(r, feature, "inner")
        names.append(name)
    mean = None
    for n in names:
        mean = F.col(f"rank_{n}") if mean is None else mean + F.col(f"rank_{n}")
    return merged.withColumn("mean_rank", mean / F.lit(float(len(names))))


def eta_squared(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Share of target variance explained by the feature's level means (R^2 of the
    group-mean predictor), one row ``feature, eta2``."""
    n, m, v = F.count(target).alias("_n"), F.avg(target).alias("_m"), F.var_pop(target).alias("_v")
    g = df.where(F.col(feature).isNotNull()).groupBy(feature).agg(n, m, v).where(F.col("_n") > 0)
    # within-group and total squares from the groups alone: SST = SSE + sum n (m - mean)^2
    weight, mean = F.sum("_n"), F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")
    row = g.agg(F.sum(F.col("_n") * F.col("_v")).alias("_sse"), weight.alias("_w"), mean.alias("_mean"))
    between = g.crossJoin(F.broadcast(row)).agg(F.sum(F.col("_n") * (F.col("_m") - F.col("_mean")) ** 2).alias("_ssb"), F.max("_sse").alias("_sse"))
    sst = F.col("_sse") + F.col("_ssb")
    eta = F.when(sst == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.col("_sse") / sst)
    return between.select(F.lit(feature).alias("feature"), eta.alias("eta2"))


def permutation_importance(model, df: DataFrame, features: list[str], label: str, key: str,
                           repeats: int = 3, seed: int = 42, points_of=None) -> DataFrame:
    """Drop of the score (points: 100 * raw R^2 of ``points_of`` the prediction) when one feature column is
    permuted (mean / std over repeats).

    A permutation is a pairing of row positions in ``key`` order with row
    positions in a seeded-hash order (both from the distributed row numbering),
    so the shuffled column is produced by one equi-join, not a driver shuffle.
    There is one join per repeat; a tree regression scores all variants of a joined row together (``tree_scores``), for any other
    model its rows are exploded to one variant per feature and scored with a single ``transform``; then a grouped R^2.
    """
    from demandflow.operators import tree_scores
    from demandflow.operators.metrics import r2_expr
    from demandflow.operators.order import global_row_number

    base = df.select(key, label, *features)
    points_of = points_of or F.col
    ensemble = tree_scores.ensemble_of(model, base)
    if ensemble is not None and model.stages[0].getInputCols() != list(features):
        ensemble = None

    def points(scored, *by):
        scored = scored.withColumn("_p", points_of("prediction"))
        agg = (F.lit(100.0) * r2_expr(label, "_p")).alias("_points")
        return scored.groupBy(*by).agg(agg) if by else scored.agg(agg)

    whole = model.transform(base) if ensemble is None else tree_scores.predict(model, base, "prediction")
    base_points = points(whole).withColumnRenamed("_points", "_base")
    numbered = global_row_number(base, [key], "_pos")
    variants = None
    for r in range(repeats):
        h = base.withColumn("_h", F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(str(r)), F.col(key).cast("string"))))
        donor = global_row_number(h, ["_h", key], "_pos").select(
            "_pos", *[F.col(f).alias(f"_d_{f}") for f in features])
        joined = numbered.join(donor, "_pos").withColumn("_rep", F.lit(r))
        variants = joined if variants is None else variants.unionByName(joined)
    if ensemble is None:
        variants = variants.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features]))).select(
            label, "_rep", "_feature", *[F.when(F.col("_feature") == g, F.col(f"_d_{g}")).otherwise(F.col(g)).alias(g) for g in features])
        scored = points(model.transform(variants), "_feature", "_rep")
    else:
        variants = tree_scores.predict_replaced(model, variants, [f"_d_{f}" for f in features], "_each")
        variants = variants.select(label, "_rep", *[points_of(F.col("_each")[i]).alias(f"_p{i}") for i in range(len(features))])
        wide = variants.groupBy("_rep").agg(*[(F.lit(100.0) * r2_expr(label, f"_p{i}")).alias(f"_r{i}") for i in range(len(features))])
        each = F.array(*[F.struct(F.lit(f).alias("_feature"), F.col(f"_r{i}").alias("_points")) for i, f in enumerate(features)])
        scored = wide.select("_rep", F.inline(each))
    drops = scored.crossJoin(F.broadcast(base_points)).withColumn("_drop", F.col("_base") - F.col("_points"))
    return drops.groupBy(F.col("_feature").alias("feature")).agg(
        F.avg("_drop").alias("importance_mean"), F.stddev_pop("_drop").alias("importance_std"))


def shapley_importance(model, sample: DataFrame, background: DataFrame, features: list[str], key: str,
                       n_perms: int = 4, seed: int = 42) -> DataFrame:
    """I3 (re-aimed): mean |Shapley value| per feature by Monte-Carlo permutation
    sampling as one Spark job.

    For every sampled row and seeded feature order, the coalition chain
    S_0 c S_1 c ... c S_d is exploded into rows (features in S take the row's
    value, the others the one-row ``background`` value), scored in one batch
    ``transform``; consecutive differences along the chain are the marginal
    contributions.  Windows are per (row, permutation): d + 1 rows each.
    """
    d = len(features)
    bg = background.select(*[F.col(f).alias(f"_bg_{f}") for f in features])
    s = sample.select(key, *features).crossJoin(F.broadcast(bg))  # one-row background
    s = s.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n_perms - 1))))
    order = F.array_sort(F.array(*[F.struct(
        F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), F.col("_m").cast("string"), F.lit(f)))
        .alias("h"), F.lit(f).alias("f")) for f in features]))
    s = s.withColumn("_perm", F.transform(order, lambda x: x["f"]))
    s = s.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(d))))
    cols = {f: F.when(F.array_position("_perm", F.lit(f)) <= F.col("_j"), F.col(f)).otherwise(F.col(f"_bg_{f}"))
            for f in features}
    chain = s.select(key, "_m", "_j", "_perm", *[c.alias(f) for f, c in cols.items()])
    pred = model.transform(chain).select(key, "_m", "_j", "_perm", "prediction")
    w = Window.partitionBy(key, "_m").orderBy("_j")
    delta = pred.withColumn("_delta", F.col("prediction") - F.lag("prediction").over(w)).where(F.col("_j") > 0)
    delta = delta.withColumn("feature", F.element_at("_perm", F.col("_j")))
    phi = delta.groupBy(key, "feature").agg(F.avg("_delta").alias("_phi"))
    return phi.groupBy("feature").agg(F.avg(F.abs("_phi")).alias("mean_abs_shap"))
