"""Scores, leaderboards and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.numeric import r6, round_doubles
from demandflow.operators import ensemble as ens
from demandflow.operators import importance as imp
from demandflow.operators import metrics as mt
from demandflow.operators import splits as sp
from demandflow.functions import categorical as cat
from demandflow.plans.common import obs, obs_t, tgt_of
from demandflow.plans.registry import BP_SQL, R, register, with_obs
from demandflow.sources.observations import base_predictions

_MODELS = ["pa", "pb", "pc"]


def _r2(p, y="demand"):
    return f"(1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*)))"


@register("r2_score", with_obs(" UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*) AS n, {R(_r2(m))} AS r2, {R(f'greatest(0.0, 100 * {_r2(m)})')} AS score "
    f"FROM bp" for m in _MODELS), *BP_SQL))
def q_r2_score(spark, sf):
    """M1: R^2 and competition score of each base prediction on the target period."""
    bp = base_predictions(obs(spark, sf))
    long = bp.select("idx", "demand", *_MODELS).unpivot(["idx", "demand"], _MODELS, "model", "pred")
    return round_doubles(mt.r2_score(long, "demand", "pred", by=["model"]))


def _auc_sql(label):
    return (f"SELECT '{label}' AS label, cast(sum({label}) AS bigint) AS n_pos, "
            f"cast(count(*) - sum({label}) AS bigint) AS n_neg, "
            f"{R(f'(sum(CASE WHEN {label} = 1 THEN rk END) - sum({label}) * (sum({label}) + 1) / 2.0) / (sum({label}) * (count(*) - sum({label})))')} AS auc "
            f"FROM (SELECT {label}, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk "
            f"FROM ld WHERE {label} IS NOT NULL AND s IS NOT NULL) r")


@register("roc_auc", f"""WITH ld AS (SELECT l.quality, l.toxic, cast(d.n_chars AS double) AS s
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
{_auc_sql('quality')} UNION ALL {_auc_sql('toxic')}""")
def q_roc_auc(spark, sf):
    """M3: exact ROC-AUC of document length as a score for the quality / toxic labels."""
    from demandflow.sources.observations import table
    ld = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id") \
        .withColumn("s", F.col("n_chars").cast("double"))
    # both labels in one pass
    long = ld.unpivot(["s"], ["quality", "toxic"], "label", "y").where(F.col("y").isNotNull() & F.col("s").isNotNull())
    return mt.roc_auc(long, "y", "s", by=["label"]).select("label", "n_pos", "n_neg", r6("auc").alias("auc"))


_PROBS = ", ".join(repr(i / 10) for i in range(11))
_BP_FOLDS = [
    f"bq AS (SELECT b.*, cast(len(list_filter(edges[2:len(edges) - 1], lambda x: b.demand > x)) AS int) AS bin "
    f"FROM bp b CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(demand, [{_PROBS}]))) AS edges FROM bp) e)",
    "bf AS (SELECT bq.*, cast((row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('-', '42', "
    "cast(idx AS varchar))), idx) - 1) % 5 AS int) AS fold FROM bq)",
    f"pf AS (SELECT fold, {_r2('pa')} AS r2 FROM bf GROUP BY fold)",
]


@register("fold_summary", with_obs(f"""
SELECT {R('avg(greatest(0.0, 100 * r2))')} AS mean_score, {R('stddev_pop(greatest(0.0, 100 * r2))')} AS std_score,
       {R('avg(r2)')} AS mean_r2, {R('stddev_pop(r2)')} AS std_r2, count(*) AS n_folds,
       (SELECT {R(_r2('pa'))} FROM bf) AS oof_r2, (SELECT {R(f'greatest(0.0, 100 * {_r2("pa")})')} FROM bf) AS oof_score
FROM pf""", *BP_SQL, *_BP_FOLDS))
def q_fold_summary(spark, sf):
    """M2 + A9: per-fold scores of ``pa`` over 5 stratified folds: mean, population std, OOF score."""
    bp = base_predictions(obs(spark, sf), materialize=True)
    f = sp.target_decile_folds(bp, "demand", "idx")
    return round_doubles(mt.fold_summary(f, "demand", "pa"))


@register("variant_diff", with_obs(f"""
SELECT 'pa' AS variant_a, 'pb' AS variant_b, {R('a')} AS score_a, {R('b')} AS score_b, {R('a - b')} AS diff,
  CASE WHEN a - b > 0.5 THEN 'better' WHEN a - b < -0.5 THEN 'worse' WHEN abs(a - b) <= 0.1 THEN 'same'
       ELSE 'marginal' END AS verdict
FROM (SELECT 100 * {_r2('pa')} AS a, 100 * {_r2('pb')} AS b FROM bp) s""", *BP_SQL))
def q_variant_diff(spark, sf):
    """M4: difference of two variants' (raw) scores with a three-way verdict."""
    bp = base_predictions(obs(spark, sf))
    s = bp.agg((F.lit(100.0) * mt.r2_expr("demand", "pa")).alias("score_a"),
               (F.lit(100.0) * mt.r2_expr("demand", "pb")).alias("score_b"))
    s = s.select(F.lit("pa").alias("variant_a"), F.lit("pb").alias("variant_b"), "score_a", "score_b",
                 (F.col("score_a") - F.col("score_b")).alias("diff"),
                 mt.variant_diff(F.col("score_a"), F.col("score_b")).alias("verdict"))
    return round_doubles(s)


_LB = [
    "eq AS (SELECT *, (pa + pb + pc) / 3.0 AS pe FROM bp)",
    "lb0 AS (" + " UNION ALL ".join(f"SELECT '{n}' AS model, {_r2(c)} AS r2 FROM eq"
                                    for n, c in [("pa", "pa"), ("pb", "pb"), ("pc", "pc"), ("equal_blend", "pe")])
    + ")",
    "lb AS (SELECT model, r2, greatest(0.0, 100 * r2) AS score, "
    "cast(row_number() OVER (ORDER BY r2 DESC, model) AS int) AS position FROM lb0)",
]


def _leaderboard(spark, sf):
    bp = ens.blend_equal(base_predictions(obs(spark, sf)), _MODELS, "equal_blend")
    cols = [*_MODELS, "equal_blend"]
    s = bp.agg(*[mt.r2_expr("demand", c).alias(c) for c in cols])
    long = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("r2"))
                                        for c in cols])).alias("x")).select("x.*")
    long = long.withColumn("score", mt.score_expr(F.col("r2")))
    from pyspark.sql import Window
    w = Window.orderBy(F.col("r2").desc(), F.col("model"))  # one row per model: bounded
    return bp, long.withColumn("position", F.row_number().over(w))


@register("leaderboard", with_obs(f"SELECT model, {R('r2')} AS r2, {R('score')} AS score, position FROM lb",
                                  *BP_SQL, *_LB))
def q_leaderboard(spark, sf):
    """M5 + W7: models and blends ranked by raw R^2 (name tie-break)."""
    _, lb = _leaderboard(spark, sf)
    return round_doubles(lb)


@register("select_best", with_obs(f"""
SELECT eq.idx, lb.model AS approach,
  {R("CASE lb.model WHEN 'pa' THEN pa WHEN 'pb' THEN pb WHEN 'pc' THEN pc ELSE pe END")} AS prediction
FROM eq CROSS JOIN (SELECT model FROM lb WHERE position = 1) lb""", *BP_SQL, *_LB))
def q_select_best(spark, sf):
    """A8 + B6: pick the top approach of the leaderboard and emit its predictions."""
    bp, lb = _leaderboard(spark, sf)
    best = lb.where(F.col("position") == 1).select(F.col("model").alias("approach"))
    long = ens.to_long(bp.select("idx", *_MODELS, "equal_blend"), "idx", [*_MODELS, "equal_blend"])
    return long.join(F.broadcast(best), long["model"] == best["approach"], "inner") \
               .select("idx", "approach", r6("pred").alias("prediction"))


@register("group_mean", with_obs(f"""
SELECT road_type, weather, {R('avg(demand)')} AS mean_demand, count(*) AS n FROM obs
WHERE road_type IS NOT NULL AND weather IS NOT NULL GROUP BY road_type, weather"""))
def q_group_mean(spark, sf):
    """A1: group mean over two keys (null keys dropped, like pandas groupby)."""
    o = obs(spark, sf).where(F.col("road_type").isNotNull() & F.col("weather").isNotNull())
    return round_doubles(o.groupBy("road_type", "weather").agg(F.avg("demand").alias("mean_demand"),
                                                                F.count(F.lit(1)).alias("n")))


_FEATS = ["hour", "slot", "day", "temperature", "number_of_lanes", "rt", "wt"]
_FEAT_SQL = ("fx AS (SELECT *, CASE road_type WHEN 'Residential' THEN 0 WHEN 'Commercial' THEN 1 "
             "WHEN 'Highway' THEN 2 END AS rt, CASE weather WHEN 'Sunny' THEN 0 WHEN 'Cloudy' THEN 1 "
             "WHEN 'Rainy' THEN 2 WHEN 'Snowy' THEN 3 END AS wt FROM obs_t WHERE day > 20)")


def _eta_sql(f):
    return (f"SELECT '{f}' AS feature, 1 - sum((demand - gm) * (demand - gm)) / (var_pop(demand) * count(*)) AS eta2 "
            f"FROM fx JOIN (SELECT {f} AS k, avg(demand) AS gm FROM fx WHERE {f} IS NOT NULL GROUP BY {f}) g "
            f"ON fx.{f} = g.k")


def _drank(c):
    return f"(rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@register("rank_merge", with_obs(f"""
SELECT feature, {R('abs_corr')} AS abs_corr, {R('abs_cov')} AS abs_cov, {R('eta2')} AS eta2,
  {R('r1')} AS rank_abs_corr, {R('r2')} AS rank_abs_cov, {R('r3')} AS rank_eta2, {R('(r1 + r2 + r3) / 3.0')} AS mean_rank
FROM (SELECT feature, abs_corr, {_drank('abs_corr')} AS r1 FROM ia) a
JOIN (SELECT feature, abs_cov, {_drank('abs_cov')} AS r2 FROM ib) b USING (feature)
JOIN (SELECT feature, eta2, {_drank('eta2')} AS r3 FROM ic) c USING (feature)""", _FEAT_SQL,
    "ia AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, demand)) AS abs_corr FROM fx"
                                   for f in _FEATS) + ")",
    "ib AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(covar_pop({f}, demand)) AS abs_cov FROM fx"
                                   for f in _FEATS) + ")",
    "ic AS (" + " UNION ALL ".join(_eta_sql(f) for f in _FEATS) + ")"))
def q_rank_merge(spark, sf):
    """I4 + J5 + W3: three importance tables (|Pearson|, |covariance|, eta^2) inner
    joined on the feature, descending average ranks and their mean."""
    o = tgt_of(obs_t(spark, sf))
    o = o.withColumns({"rt": cat.ordinal("road_type", cat.ROAD_TYPE_CODES),
                       "wt": cat.ordinal("weather", cat.WEATHER_CODES)})
    row = o.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col("demand"))).alias(f"c_{f}") for f in _FEATS],
                *[F.abs(F.covar_pop(F.col(f).cast("double"), F.col("demand"))).alias(f"v_{f}") for f in _FEATS])
    ia = row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"c_{f}").alias("abs_corr"))
                                        for f in _FEATS])).alias("x")).select("x.*")
    ib = row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"v_{f}").alias("abs_cov"))
                                        for f in _FEATS])).alias("x")).select("x.*")
    ic = None
    for f in _FEATS:
        e = imp.eta_squared(o, f, "demand")
        ic = e if ic is None else ic.unionByName(e)
    merged = imp.rank_merge({"abs_corr": ia, "abs_cov": ib, "eta2": ic})
    return round_doubles(merged)
