"""Rows-only queries for fitted models, searches and importance (no SQL oracle:
their results depend on a fitted model or a seeded search)."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from demandflow.functions import categorical as cat
from demandflow.functions import geo, time
from demandflow.functions.numeric import clip, exp_target, log_target, r6, round_doubles
from demandflow.operators import encoders as enc
from demandflow.operators import ensemble as ens
from demandflow.operators import features as feat
from demandflow.operators import forecast as fc
from demandflow.operators import importance as imp
from demandflow.operators import metrics as mt
from demandflow.operators import models as md
from demandflow.operators import splits as sp
from demandflow.operators.extra_trees import ExtraTrees
from demandflow.operators.fits import Fit, FitPlan
from demandflow.operators.histogram_trees import share_out, slots
from demandflow.operators.order import global_row_number
from demandflow.plans.catalog.ensemble import _GRID
from demandflow.plans.catalog.forecast import _TS
from demandflow.plans.common import obs, obs_t, ref_of, tgt_of
from demandflow.plans.registry import BP_SQL, R, register, with_obs
from demandflow.session import materialize
from demandflow.sources import io
from demandflow.sources.observations import base_predictions, lookup_samples

TIME_FEATURES = ["hour", "quarter_hour", "day_of_week", "is_rush_hour", "is_night"]
CAT_FEATURES = ["road_type_encoded", "weather_encoded", "large_vehicles_encoded", "landmarks_encoded"]
NUM_FEATURES = ["temperature", "number_of_lanes", "n_missing"]
GEO_FEATURES = ["te_geohash", "geohash_count"]
FEATURES = TIME_FEATURES + CAT_FEATURES + NUM_FEATURES + GEO_FEATURES
# Rows that Shapley values are taken of, trees that early stopping may reach, trees of the randomised forest
SHAPLEY_ROWS, EARLY_STOP_TREES, EXTRA_TREES = 2000, 500, 50
# Predicates of the periods, and of the reference days that tuning fits stop by
REF, TGT, LATE_DAYS = "day <= 20", "day > 20", "day > 15 and day <= 20"


def model_frame(spark, sf):
    """Feature frame for the model operators: time, codes, missing count, the
    smoothed geohash encoding and the geohash row count (both fit on the
    reference period), every remaining null imputed with reference-period medians.
    Checkpointed: model fits scan it many times."""
    o = obs(spark, sf)
    o = time.all_time_features(o)
    o = cat.ordinal_encode(o)
    o = cat.missing_flags(o)
    ref = ref_of(o)
    o = enc.apply_smoothed(o, enc.fit_smoothed(ref, ["geohash"], "demand"), ["geohash"], "te_geohash")
    o = o.join(enc.fit_group_count(ref, "geohash", "geohash_count"), "geohash", "left") \
         .withColumn("geohash_count", F.coalesce(F.col("geohash_count").cast("double"), F.lit(0.0)))
    num = [c for c in FEATURES]
    o = o.select("idx", "day", "slot" if "slot" in o.columns else F.col("quarter_hour").alias("slot"),
                 "geohash", "demand", *[F.col(c).cast("double").alias(c) for c in num])
    fitted = feat.fit_imputer(ref_of(o), CAT_FEATURES + NUM_FEATURES)
    o = feat.apply_imputer(o, fitted, CAT_FEATURES + NUM_FEATURES)
    return materialize(o.withColumn("log_demand", log_target("demand")), "model-frame")


def preset_fit(name: str, rows: str = REF, features: list[str] = FEATURES, label: str = "demand", valid: str | None = None, **params) -> Fit:
    """A fit of a boosted preset on the rows of a model frame."""
    return Fit.of(rows, features, label, {**md.GBT_PRESETS[name], **params}, valid)


def _demand_of(prediction):
    """The demand that a log-target prediction stands for."""
    return clip(exp_target(prediction), 0.0, 1.0)


@register("gbt_predictions")
def q_gbt_predictions(spark, sf):
    """L1: three boosted-tree presets fit on the reference period, target-period predictions."""
    m = model_frame(spark, sf)
    tgt = tgt_of(m)
    out = tgt.select("idx", "demand", *FEATURES)
    for name, fitted in zip(md.GBT_PRESETS, FitPlan(m).run([preset_fit(n) for n in md.GBT_PRESETS]), strict=True):
        out = md.predict(fitted.model, out, name)
    return out.select("idx", "demand", *md.GBT_PRESETS)


@register("forest_predictions")
def q_forest_predictions(spark, sf):
    """L2: extremely randomised trees (random thresholds per tree), target-period predictions."""
    m = model_frame(spark, sf)
    trees = ExtraTrees(FEATURES, "demand", n_trees=EXTRA_TREES).fit(ref_of(m))
    return trees.predict(tgt_of(m), "forest").select("idx", "forest")


@register("cv_oof")
def q_cv_oof(spark, sf):
    """L3 + L4: 5-fold stratified out-of-fold predictions on the reference period (each fold's model stopped by
    patience on its fold) and fold-averaged target predictions."""
    m = model_frame(spark, sf)
    ref = materialize(sp.target_decile_folds(ref_of(m), "demand", "idx"), "folds")
    oof, test = md.cv_oof(FitPlan(ref), "fold", "idx", FEATURES, "demand", md.GBT_PRESETS["gbt_b"], tgt_of(m), "gbt_b")
    test_rows = test.select("idx", F.lit("gbt_b_test").alias("model"), F.lit(-1).alias("fold"),
                            F.lit(None).cast("double").alias("demand"), F.col("test_pred").alias("oof"))
    return oof.unionByName(test_rows)


@register("early_stop")
def q_early_stop(spark, sf):
    """L4: early stopping by patience on the last days of the reference period, of at most 500 trees; the best tree
    count, the rounds that were fitted, and the validation score of the cut model."""
    m = model_frame(spark, sf)
    fitted = FitPlan(m).fit(preset_fit("gbt_a", "day <= 15", valid=LATE_DAYS, maxIter=EARLY_STOP_TREES))
    r2, score = md.score(md.predict(fitted.model, m.where(LATE_DAYS)), "demand", "pred")
    return spark.createDataFrame([(fitted.n_trees, fitted.n_fitted, r2, score)], "n_trees int, n_fitted int, valid_r2 double, valid_score double")


@register("meta_models")
def q_meta_models(spark, sf):
    """Linear / ridge / elastic-net meta-regressions on the base predictions
    (fit on even ids, scored on the odd ones)."""
    bp = base_predictions(obs(spark, sf))
    fit, check = bp.where(F.col("idx") % 2 == 0), bp.where(F.col("idx") % 2 == 1)
    rows = []
    for name, model in md.meta_models(fit, ["pa", "pb", "pc"], "demand").items():
        pred = model.transform(check).withColumn("p", clip("prediction", 0.0, 1.0))
        r2, score = md.score(pred, "demand", "p")
        lr = model.stages[-1]
        rows.append((name, r2, score, json.dumps([float(c) for c in lr.coefficients]), float(lr.intercept)))
    return spark.createDataFrame(rows, "meta string, r2 double, score double, coefficients string, intercept double")


@register("final_predictions")
def q_final_predictions(spark, sf):
    """Refit on the labelled rows of both periods, predict the unlabelled ids, clip to [0, 1]."""
    m = model_frame(spark, sf)
    train, test = lookup_samples(m)
    fitted = FitPlan(train).fit(preset_fit("gbt_a", "true"))
    p = md.predict(fitted.model, test, "p")
    return p.select("idx", clip("p", 0.0, 1.0).alias("demand"))


@register("adversarial_auc")
def q_adversarial_auc(spark, sf):
    """V9 + L9 + V3 + M3: two classifiers tell reference from target rows out of fold; AUC and averaged
    importances of each (top 15 flagged as shifted when AUC > 0.70).

    No feature is fitted on one of the two periods: such a column gives the label away.
    """
    m = model_frame(spark, sf)
    feats = [f for f in FEATURES if f not in GEO_FEATURES]
    u = sp.union_flagged(ref_of(m), tgt_of(m)).withColumn("is_test", F.col("is_test").cast("double"))
    u = materialize(sp.stratified_folds(u, "is_test", "idx"), "adversarial-folds")
    tasks, _ = share_out(u.count(), 1, slots(spark))
    rows = []
    for name, pipe in {"gbt": md.gbt_classifier(feats, "is_test"), "forest": md.forest_classifier(feats, "is_test")}.items():
        fitted = md.fit_classifiers(pipe, u, [f"fold <> {f}" for f in range(5)], tasks, slots(spark))
        parts = [(md.positive_probability(model, u.where(F.col("fold") == f)).select("idx", "is_test", "proba"), dict(md.feature_importances(model, feats)))
                 for f, model in enumerate(fitted)]
        oof = parts[0][0]
        for o, _ in parts[1:]:
            oof = oof.unionByName(o)
        auc = mt.roc_auc(oof, "is_test", "proba").first()["auc"]
        avg = sorted(((f, sum(i[f] for _, i in parts) / len(parts)) for f in feats), key=lambda t: (-t[1], t[0]))
        rows += [(name, f, v, k + 1, float(auc), int(auc > 0.70 and k < 15)) for k, (f, v) in enumerate(avg)]
    return spark.createDataFrame(rows, "classifier string, feature string, importance double, rank int, auc double, shifted int")


@register("validation_gap")
def q_validation_gap(spark, sf):
    """V8: mean R^2 of 5 CV folds on the reference period vs the time-holdout score; gap flag > 0.02.

    Both sides stop by patience on the rows that they are scored on, so that like is compared with like."""
    m = model_frame(spark, sf)
    ref = materialize(sp.target_decile_folds(ref_of(m), "demand", "idx"), "folds")
    oof, _ = md.cv_oof(FitPlan(ref), "fold", "idx", FEATURES, "demand", md.GBT_PRESETS["gbt_b"])
    cv_r2 = mt.r2_score(oof, "demand", "oof", by=["fold"]).agg(F.avg("r2").alias("m")).first()["m"]
    holdout = FitPlan(m).fit(preset_fit("gbt_b", valid=TGT))
    ho_r2, _ = md.score(md.predict(holdout.model, tgt_of(m)), "demand", "pred")
    gap = cv_r2 - ho_r2
    return spark.createDataFrame([(cv_r2, ho_r2, gap, int(gap > 0.02))],
                                 "cv_r2 double, holdout_r2 double, gap double, leaky int")


@register("target_experiment")
def q_target_experiment(spark, sf):
    """M7 + F19: raw vs log1p target (predictions expm1'd and clipped), both scored; the verdict
    compares points of raw R^2, +-0.5 being no difference."""
    m = model_frame(spark, sf)
    tgt = tgt_of(m)
    by_raw, by_log = FitPlan(m).run([preset_fit("gbt_b"), preset_fit("gbt_b", label="log_demand")])
    raw = md.predict(by_raw.model, tgt).withColumn("p", clip("pred", 0.0, 1.0))
    lg = md.predict(by_log.model, tgt).withColumn("p", clip(exp_target("pred"), 0.0, 1.0))
    r_raw, s_raw = md.score(raw, "demand", "p")
    r_log, s_log = md.score(lg, "demand", "p")
    d = 100.0 * (r_log - r_raw)
    verdict = "better" if d > 0.5 else "worse" if d < -0.5 else "same"
    return spark.createDataFrame([("raw", r_raw, s_raw, verdict), ("log1p", r_log, s_log, verdict)],
                                 "target string, r2 double, score double, verdict string")


@register("ts_forecast")
def q_ts_forecast(spark, sf):
    """T7 + L4: boosted forecaster on the template features of the labelled target rows;
    early slots fit, later slots validate (early stopping), refit on all labelled rows with
    the found tree count, forecast the unlabelled target rows (every 5th id)."""
    o = obs_t(spark, sf)
    ref, tgt = ref_of(o), tgt_of(o)
    labelled, unlabelled = lookup_samples(tgt)
    templates = fc.fit_templates(ref, labelled)
    feats = fc.TS_FEATURES

    def frame(rows, label):
        return fc.ts_features(rows, templates).select("idx", label, *[F.col(c).cast("double").alias(c) for c in feats])

    f = frame(labelled, F.col("demand"))
    med = materialize(feat.fit_imputer(f, feats), "ts-medians")
    f = materialize(feat.apply_imputer(f, med, feats), "ts-features")
    ahead = feat.apply_imputer(frame(unlabelled, F.lit(None).cast("double").alias("demand")), med, feats)
    plan = FitPlan(f)
    n_trees = plan.fit(preset_fit("gbt_b", "slot <= 5", features=feats, valid="slot > 5", maxIter=EARLY_STOP_TREES)).n_trees
    final = plan.fit(preset_fit("gbt_b", "true", features=feats, maxIter=n_trees))
    return md.predict(final.model, ahead, "forecast").select("idx", "forecast", F.lit(n_trees).alias("n_trees"))


@register("encoding_bakeoff_model")
def q_encoding_bakeoff_model(spark, sf):
    """E12 with the model scorer: the same boosted preset fit on the reference period
    with the geohash encoding swapped between mean, median and smoothed (all fit on
    the reference period), log target, predictions expm1'd and clipped, scored on
    the target period; best by raw R^2 (name tie-break)."""
    m = model_frame(spark, sf)
    ref = ref_of(m)
    variants = {"mean": enc.fit_mean(ref, ["geohash"], "demand"),
                "median": enc.fit_median(ref, ["geohash"], "demand"),
                "smoothed": enc.fit_smoothed(ref, ["geohash"], "demand", alpha=10.0)}
    base = [f for f in FEATURES if f != "te_geohash"]
    for name, fitted in variants.items():
        m = enc.apply_mean(m, fitted, ["geohash"], f"by_{name}")
    m = materialize(m, "encoded-frame")
    fits = FitPlan(m).run([preset_fit("gbt_b", label="log_demand", features=[*base, f"by_{v}"]) for v in variants])
    rows = []
    for name, x in zip(variants, fits, strict=True):
        rows.append((name, *md.score(md.predict(x.model, tgt_of(m)).withColumn("p", _demand_of("pred")), "demand", "p")))
    scores = spark.createDataFrame(rows, "encoding string, r2 double, score double")
    return ens.rank_scores(scores, "r2", "encoding")


@register("spatial_clusters")
def q_spatial_clusters(spark, sf):
    """30 k-means clusters of decoded geohash centres, each weighted by its rows in the reference
    period, best of 10 seeded starts by training cost; every geohash assigned to its nearest centre."""
    o = obs(spark, sf)
    rows = ref_of(o).where(F.col("geohash").isNotNull()).groupBy("geohash").agg(F.count(F.lit(1)).cast("double").alias("n_rows"))
    pts = geo.geohash_decode(rows)
    va = VectorAssembler(inputCols=["lat", "lon"], outputCol="features")
    data = materialize(va.transform(pts), "geo-points")
    k = min(30, data.count())
    def start(s):
        model = KMeans(k=k, seed=42 + s, featuresCol="features", weightCol="n_rows").fit(data)
        return model.summary.trainingCost, s, model

    with ThreadPoolExecutor(max_workers=4) as ex:  # independent seeded starts
        fits = list(ex.map(start, range(10)))
    best = min(fits, key=lambda t: (t[0], t[1]))
    best = (best[0], best[2])
    allg = va.transform(geo.geohash_decode(o.select("geohash").distinct().where(F.col("geohash").isNotNull())))
    return best[1].transform(allg).select("geohash", "lat", "lon", F.col("prediction").alias("cluster"))


_NATIVE = ["road_type", "weather", "large_vehicles", "landmarks", "geohash"]


def _native_sql() -> str:
    levels = [f"l_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM "
              f"(SELECT DISTINCT coalesce({c}, 'MISSING') AS v FROM obs WHERE day <= 20) x)" for c in _NATIVE]
    cols = ", ".join(f"cast(coalesce(l_{c}.i, (SELECT count(*) FROM l_{c})) AS int) AS {c}_idx" for c in _NATIVE)
    joins = " ".join(f"LEFT JOIN l_{c} ON l_{c}.v = coalesce(o.{c}, 'MISSING')" for c in _NATIVE)
    return with_obs(f"SELECT o.idx, {cols} FROM obs o {joins}", *levels)


@register("native_categories", _native_sql())
def q_native_categories(spark, sf):
    """Raw category strings (null -> MISSING) indexed in code-point order with an
    extra index for unseen levels; ``maxBins`` must cover the geohash cardinality."""
    o = obs(spark, sf)
    cols = _NATIVE
    df = o.select("idx", "day", *[cat.sentinel(c).alias(c) for c in cols])
    ref = ref_of(df)
    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep",
                        stringOrderType="alphabetAsc").fit(ref)
    return idx.transform(df).select("idx", *[F.col(f"{c}_idx").cast("int").alias(f"{c}_idx") for c in cols])


@register("gain_importance")
def q_gain_importance(spark, sf):
    """Gain importances of a boosted model, sorted."""
    m = model_frame(spark, sf)
    model = FitPlan(m).fit(preset_fit("gbt_a")).model
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(md.feature_importances(model, FEATURES))]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """Permutation importance (3 seeded repeats) on the target period, in points of the
    clipped prediction of a log-target model."""
    m = model_frame(spark, sf)
    model = FitPlan(m).fit(preset_fit("gbt_a", label="log_demand")).model
    return imp.permutation_importance(model, tgt_of(m), FEATURES, "demand", "idx", points_of=_demand_of)


@register("shapley_importance")
def q_shapley_importance(spark, sf):
    """Mean |Shapley| per feature from sampled permutations (2,000 rows x 4 orders)."""
    m = model_frame(spark, sf)
    model = FitPlan(m).fit(preset_fit("gbt_a")).model
    sample = sp.hash_sample(tgt_of(m), "idx", SHAPLEY_ROWS)
    background = ref_of(m).agg(*[F.avg(f).alias(f) for f in FEATURES])
    return imp.shapley_importance(model, sample, background, FEATURES, "idx", n_perms=4)


@register("feature_elimination")
def q_feature_elimination(spark, sf):
    """Drop features whose permutation importance is <= 0.001 points, refit, keep the
    reduced set only if it wins by more than 0.05 points (log target, clipped predictions)."""
    m = model_frame(spark, sf)
    tgt, plan = tgt_of(m), FitPlan(m)
    model = plan.fit(preset_fit("gbt_b", label="log_demand")).model
    pi = imp.permutation_importance(model, tgt, FEATURES, "demand", "idx", points_of=_demand_of)
    weak = [r["feature"] for r in pi.where(F.col("importance_mean") <= 0.001).collect()]  # <= one row per feature
    kept = [f for f in FEATURES if f not in weak] or FEATURES
    def points(pred):
        return md.points(pred.withColumn("p", _demand_of("pred")), "demand", "p")

    s_all = points(md.predict(model, tgt))
    s_red = points(md.predict(plan.fit(preset_fit("gbt_b", label="log_demand", features=kept)).model, tgt))
    return spark.createDataFrame([(json.dumps(weak), len(kept), s_all, s_red, int(s_red - s_all > 0.05))],
                                 "dropped string, n_kept int, score_all double, score_reduced double, keep_reduced int")


@register("stacking")
def q_stacking(spark, sf):
    """Rolling pseudo-OOF of three boosted presets (log target) on the reference
    period -> meta regressions -> applied to the target-period predictions of the
    same presets fit on the whole reference period -> clipped -> scored.

    The presets' tree counts are tuned first: stopped by patience on the last days of the reference period."""
    m = model_frame(spark, sf)
    ref, tgt = ref_of(m), tgt_of(m)
    # expanding folds as ranges of the row position, which is attached (and written) once
    numbered = global_row_number(ref, ["day", "slot", "idx"], "_rn")
    n_rows = numbered.count()
    size = n_rows // 6
    names = list(md.GBT_PRESETS)
    plan = FitPlan(numbered)
    tuned = plan.run([preset_fit(n, "day <= 15", label="log_demand", valid=LATE_DAYS) for n in names])
    trees = {n: x.n_trees for n, x in zip(names, tuned, strict=True)}
    starts = [n_rows - (5 - i) * size for i in range(5)]
    jobs = [(f"_rn <= {at}", f"_rn > {at} and _rn <= {at + size}", n) for at in starts for n in names] + [("true", None, n) for n in names]
    fits = plan.run([preset_fit(n, rows, label="log_demand", maxIter=trees[n]) for rows, _, n in jobs])
    oof, tgt_preds = None, tgt
    for (_, held, n), x in zip(jobs, fits, strict=True):
        if held is None:
            tgt_preds = md.predict(x.model, tgt_preds, "p").withColumn(n, _demand_of("p")).drop("p")
        else:
            part = md.predict(x.model, numbered.where(held), "p").select("idx", F.lit(n).alias("model"), _demand_of("p").alias("pred"))
            oof = part if oof is None else oof.unionByName(part)
    meta_x = ens.align(oof, "idx", names).join(ref.select("idx", "demand"), "idx")
    rows = []
    for name, model in md.meta_models(meta_x, names, "demand").items():
        pr = model.transform(tgt_preds).withColumn("p", clip("prediction", 0.0, 1.0))
        r2, score = md.score(pr, "demand", "p")
        rows.append((name, r2, score))
    return spark.createDataFrame(rows, "meta string, r2 double, score double")


@register("blend_optimal")
def q_blend_optimal(spark, sf):
    """Exact simplex-constrained blend weights from the moments (driver-side k x k QP)."""
    bp = base_predictions(obs(spark, sf))
    res = ens.blend_optimal(bp, "demand", ["pa", "pb", "pc"])
    return spark.createDataFrame([(k, v, res["r2"]) for k, v in res["weights"].items()],
                                 "model string, weight double, r2 double")


@register("write_predictions", with_obs(f"SELECT idx AS \"Index\", {R('heur')} AS demand FROM feat", *_TS))
def q_write_predictions(spark, sf):
    """IO4: write the heuristic forecast as a header CSV and read it back."""
    o = obs_t(spark, sf)
    ref, tgt = ref_of(o), tgt_of(o)
    preds = fc.ts_features(tgt, fc.fit_templates(ref, tgt)).select(
        F.col("idx").alias("Index"), F.col("heuristic_demand").alias("demand"))
    path = io.write_table(preds, io.scratch_path(spark, "predictions"), "csv")
    back = spark.read.schema("Index long, demand double").option("header", True).csv(path)
    return back.select("Index", r6("demand").alias("demand"))


@register("weights_roundtrip", with_obs(
    f"SELECT {R('w0')} AS w_pa, {R('w1')} AS w_pb, {R('w2')} AS w_pc FROM best", *BP_SQL, *_GRID))
def q_weights_roundtrip(spark, sf):
    """IO5: persist the lattice-optimal blend weights as JSON and reload them."""
    bp = base_predictions(obs(spark, sf))
    best = ens.blend_grid(bp, "demand", ["pa", "pb", "pc"]).where(F.col("is_best") == 1).first()
    path = io.write_json_row(spark, {"w_pa": best["w_pa"], "w_pb": best["w_pb"], "w_pc": best["w_pc"]},
                             io.scratch_path(spark, "weights"))
    return round_doubles(spark.read.schema("w_pa double, w_pb double, w_pc double").json(path))


@register("model_roundtrip", with_obs(
    "SELECT count(*) AS n, cast(0 AS double) AS max_abs_diff, 1 AS same_params FROM obs WHERE day > 20"))
def q_model_roundtrip(spark, sf):
    """IO6: save a fitted pipeline, load it, compare predictions and parameters."""
    m = model_frame(spark, sf)
    model = FitPlan(m).fit(preset_fit("gbt_b")).model
    path = io.scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = md.predict(model, tgt_of(m), "a").select("idx", "a")
    b = md.predict(loaded, tgt_of(m), "b").select("idx", "b")

    def params(fitted):
        return {p.name: v for p, v in fitted.stages[-1].extractParamMap().items() if isinstance(v, (int, float, str))}

    same = int(params(loaded) == params(model))
    return a.join(b, "idx").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff")) \
            .withColumn("same_params", F.lit(same))
