"""Model fitting on Spark ML.

The boosted-tree libraries of the reference are re-aimed on MLlib trees: a
few named presets of ``GBTRegressor`` stand in for the distinct boosted
models.  Fits are distributed jobs; only fitted parameters, scores and trial tables reach the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators import tree_scores
from demandflow.operators.fits import PATIENCE, Fit, FitPlan, boosted_model, boosting
from demandflow.operators.histogram_trees import as_model, grow_together, grow_trees
from demandflow.operators.metrics import r2_expr

# Trees of a preset: the reference fits 300 and more
GBT_TREES = 300

# Named presets standing in for the reference's three boosted models (depth /
# step / subsampling / bins differ so their predictions differ).
GBT_PRESETS = {
    "gbt_a": dict(maxDepth=6, stepSize=0.15, subsamplingRate=0.8, maxIter=GBT_TREES, maxBins=64, seed=42),
    "gbt_b": dict(maxDepth=5, stepSize=0.2, subsamplingRate=1.0, maxIter=GBT_TREES, maxBins=32,
                  minInstancesPerNode=20, seed=42),
    "gbt_c": dict(maxDepth=4, stepSize=0.25, subsamplingRate=0.7, maxIter=GBT_TREES, maxBins=128,
                  featureSubsetStrategy="sqrt", seed=42),
}


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error")


def gbt(features: list[str], label: str, preset: str = "gbt_a", **over) -> Pipeline:
    params = {**GBT_PRESETS[preset], **over}
    return Pipeline(stages=[assembler(features), GBTRegressor(featuresCol="features", labelCol=label, **params)])


def predict(model: PipelineModel, df: DataFrame, out: str = "pred") -> DataFrame:
    return tree_scores.predict(model, df, out)


def fit_predict(pipe: Pipeline, train: DataFrame, test: DataFrame, out: str = "pred") -> DataFrame:
    return predict(pipe.fit(train), test, out)


def points(df: DataFrame, y: str, p: str) -> float:
    """100 * raw R^2: unlike the score it is not clipped at 0, so that differences of bad models count."""
    return 100.0 * score(df, y, p)[0]


def score(df: DataFrame, y: str, p: str) -> tuple[float, float]:
    r = df.agg(r2_expr(y, p).alias("r2")).first()["r2"]
    return float(r), max(0.0, 100.0 * float(r))


def cv_oof(plan: FitPlan, fold_col: str, key: str, features: list[str], label: str, params: dict, test: DataFrame | None = None,
           name: str = "model", patience: int | None = PATIENCE) -> tuple[DataFrame, DataFrame | None]:
    """L3: out-of-fold predictions (fit on fold <> f, stopped by and predicting fold = f) as a long table ``key, model,
    fold, label, oof``; test predictions averaged over the fold models.  The fold fits are one plan.  ``patience``
    None: no early stopping."""
    df = plan.frame
    folds = [r[0] for r in df.select(fold_col).where(F.col(fold_col).isNotNull()).distinct().orderBy(fold_col).collect()]  # k values
    fits = [Fit.of(f"{fold_col} <> {f}", features, label, params, None if patience is None else f"{fold_col} = {f}", patience or 0) for f in folds]
    oof, tests = None, None
    for f, fitted in zip(folds, plan.run(fits), strict=True):
        o = predict(fitted.model, df.where(F.col(fold_col) == f), "oof").select(key, F.lit(name).alias("model"), F.lit(f).alias("fold"), label, "oof")
        oof = o if oof is None else oof.unionByName(o)
        if test is not None:
            t = predict(fitted.model, test, "p").select(key, "p")
            tests = t if tests is None else tests.unionByName(t)
    return oof, None if tests is None else tests.groupBy(key).agg(F.avg("p").alias("test_pred"))


def ridge_params(alpha: float, n: int, sigma_y_pop: float) -> dict:
    """sklearn ``Ridge(alpha)`` -> Spark ``LinearRegression`` parameters (normal solver)."""
    return dict(regParam=alpha / n * sigma_y_pop, elasticNetParam=0.0, standardization=False, solver="normal")


def elastic_net_params(alpha: float, l1_ratio: float, sigma_y_pop: float) -> dict:
    """sklearn ``ElasticNet(alpha, l1_ratio)`` -> Spark parameters."""
    reg = alpha * l1_ratio + alpha * (1 - l1_ratio) * sigma_y_pop
    return dict(regParam=reg, elasticNetParam=(alpha * l1_ratio / reg) if reg else 0.0, standardization=False)


def meta_models(train: DataFrame, features: list[str], label: str) -> dict[str, PipelineModel]:
    """Linear, ridge(1.0) and elastic-net(0.1, 0.5) meta-regressions."""
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("s")).first()
    n, s = int(st["n"]), float(st["s"] or 0.0)
    specs = {"linear": dict(regParam=0.0, solver="normal"), "ridge": ridge_params(1.0, n, s),
             "elastic_net": elastic_net_params(0.1, 0.5, s)}
    out = {}
    for name, p in specs.items():
        pipe = Pipeline(stages=[assembler(features), LinearRegression(featuresCol="features", labelCol=label, **p)])
        out[name] = pipe.fit(train)
    return out


def gbt_classifier(features: list[str], label: str, **over) -> Pipeline:
    """Binary classifier with probabilities: 100 trees of depth 5, rate 0.1."""
    params = {**dict(maxDepth=5, maxIter=100, stepSize=0.1, seed=42), **over}
    return Pipeline(stages=[assembler(features), GBTClassifier(featuresCol="features", labelCol=label, **params)])


def forest_classifier(features: list[str], label: str, **over) -> Pipeline:
    """The second classifier of the adversarial check: 100 trees of depth 5."""
    params = {**dict(numTrees=100, maxDepth=5, seed=42), **over}
    return Pipeline(stages=[assembler(features), RandomForestClassifier(featuresCol="features", labelCol=label, **params)])


def _classifier(pipe: Pipeline, spark) -> tuple:
    """(features, label, parameters of its trees, model of the trees) of a pipe's boosted or forest classifier."""
    assemble, est = pipe.getStages()
    features, label = assemble.getInputCols(), est.getLabelCol()
    get = {p.name: est.getOrDefault(p) for p in est.params if est.hasDefault(p) or est.isSet(p)}
    shared = {k: get[k] for k in ("maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed")}
    if isinstance(est, GBTClassifier):
        params = {**shared, **{k: get[k] for k in ("maxIter", "stepSize", "subsamplingRate", "featureSubsetStrategy")}}
        return features, label, dict(loss="logistic", **boosting(params)), lambda trees: boosted_model(spark, trees, features, label, params)

    def forest(trees):
        return PipelineModel([assemble, as_model(spark, RandomForestRegressionModel, trees, [1.0] * len(trees), len(features),
                                                 {"numTrees": len(trees), "featuresCol": "features", "predictionCol": "prediction"})])

    share = "sqrt" if get["featureSubsetStrategy"] == "auto" else get["featureSubsetStrategy"]
    return features, label, dict(loss="forest", numbers=list(range(get["numTrees"])), bootstrap=True, **boosting(shared), share=share), forest


def fit_classifier(pipe: Pipeline, train: DataFrame, tasks: int = 1) -> PipelineModel:
    """The pipe's boosted or forest classifier of a 0/1 label, as the regression ensemble that its trees are: a boosted one predicts half the
    log odds, a forest the share of ones (the Gini gain of two classes is twice the variance gain, so its splits are the same)."""
    features, label, given, model_of = _classifier(pipe, train.sparkSession)
    return model_of(grow_trees(train, None, features, label, tasks, **given)[0])


def fit_classifiers(pipe: Pipeline, frame: DataFrame, rows: list[str], tasks: int = 1, at_a_time: int = 1) -> list[PipelineModel]:
    """``fit_classifier`` on the frame's rows of each predicate: side by side on few rows, grown together on many."""
    if tasks == 1:
        with ThreadPoolExecutor(max_workers=at_a_time) as pool:
            return list(pool.map(lambda where: fit_classifier(pipe, frame.where(where)), rows))
    features, label, given, model_of = _classifier(pipe, frame.sparkSession)
    return [model_of(trees) for trees, _ in grow_together(frame, [(where, None, features, label, given) for where in rows], tasks)]


def positive_probability(model: PipelineModel, df: DataFrame, out: str = "proba") -> DataFrame:
    """df with the probability of 1 by a model of ``fit_classifier``."""
    p = F.col("_prediction")
    if not isinstance(model.stages[-1], RandomForestRegressionModel):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * p))
    return tree_scores.predict(model, df, "_prediction").withColumn(out, p).drop("_prediction")


def feature_importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Gain importances of the last stage, named (small: one number per feature)."""
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, [float(v) for v in imp]), key=lambda t: (-t[1], t[0]))


def ols_moments(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """L7 building block: the normal-equation moments of ``label ~ 1 + features`` in
    one aggregate -- ``X'X`` and ``X'y`` (plus ``y'y``) in long form ``a, b, value``.
    A (k+1) x (k+1) solve of these gives the OLS fit the meta models use."""
    names = ["one", *features, label]
    col = {n: (F.lit(1.0) if n == "one" else F.col(n).cast("double")) for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = df.agg(*[F.sum(col[a] * col[b]).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                                   F.col(f"{a}__{b}").alias("value")) for a, b in pairs]))
                      .alias("x")).select("x.*")


def solve_ols(moments: DataFrame, features: list[str], label: str) -> dict:
    """Solve the OLS normal equations from :func:`ols_moments` (bounded k x k on the driver)."""
    import numpy as np
    names = ["one", *features]
    m = {(r["a"], r["b"]): r["value"] for r in moments.collect()}  # (k+2)(k+3)/2 numbers
    k = len(names)
    A = np.array([[m.get((a, b), m.get((b, a))) for b in names] for a in names])
    y = np.array([m.get((a, label), m.get((label, a))) for a in names])
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    return {"intercept": float(beta[0]), **{f: float(b) for f, b in zip(features, beta[1:k])}}
