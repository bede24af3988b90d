"""Predictions of tree ensembles: MLlib's own, for shallow and deep trees, nominal columns, forests, models read back; permutations."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from demandflow.operators import importance, models, tree_scores
from demandflow.operators.fits import fit_with_patience

FEATURES = ["a", "b", "n"]


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    r = random.Random(4)
    rows = []
    for i in range(900):
        a, b, c = r.random(), float(r.randrange(6)), r.choice("stuvwxyz")
        rows.append((i, a, b, c, float(a > 0.4) * a + 0.3 * b * (c in "uxz") + r.gauss(0, 0.3)))
    path = str(tmp_path_factory.mktemp("scores") / "frame")
    df = spark.createDataFrame(rows, "idx long, a double, b double, c string, y double")
    StringIndexer(inputCol="c", outputCol="n", stringOrderType="alphabetAsc").fit(df).transform(df).write.parquet(path)
    return spark.read.parquet(path)


def column(df, name):
    return np.array([r[0] for r in df.orderBy("idx").select(name).collect()])


@pytest.mark.parametrize("depth", [3, 6, 8])
@pytest.mark.parametrize("kind", ["boosted", "forest", "own"])
def test_predictions_are_those_of_mllib(frame, kind, depth, monkeypatch):
    monkeypatch.setattr(tree_scores, "PIECE", 100)
    asm = VectorAssembler(inputCols=FEATURES, outputCol="features")
    if kind == "own":
        model = fit_with_patience(frame, None, FEATURES, "y", dict(maxIter=7, maxDepth=depth, seed=3), 5).model
    else:
        learner = GBTRegressor(maxIter=5, maxDepth=depth, seed=3) if kind == "boosted" else RandomForestRegressor(numTrees=6, maxDepth=depth, seed=3)
        model = Pipeline(stages=[asm, learner.setLabelCol("y").setFeaturesCol("features")]).fit(frame)
    # levels and numbers that no split knows, too
    odd = frame.withColumn("n", F.when(F.col("idx") % 7 == 0, F.lit(50.0)).otherwise(F.col("n"))) if kind != "own" else frame
    odd = odd.withColumn("a", F.when(F.col("idx") % 5 == 0, F.col("a") * 9 - 4).otherwise(F.col("a")))
    want = column(model.transform(odd), "prediction")
    got = models.predict(model, odd, "p")
    assert got.columns == [*odd.columns, "p"] and np.allclose(column(got, "p"), want, rtol=1e-12, atol=1e-12)
    assert len(set(want)) > 20
    e = tree_scores.ensemble_of(model, odd)
    assert any(t[0] is None for t in e.prepared()) == (any(len(t[0]) > 127 for t in e.trees))


def test_no_tree_is_walked_by_mllib(frame, tmp_path, monkeypatch):
    """A model that was read back from its files, too."""
    model = fit_with_patience(frame, None, FEATURES, "y", dict(maxIter=4, maxDepth=3, seed=3), 5).model
    want = column(model.transform(frame), "prediction")
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    monkeypatch.setattr(PipelineModel, "transform", None)
    for m in (model, loaded):
        assert np.allclose(column(models.predict(m, frame, "p"), "p"), want, rtol=1e-12)


def test_missing_features_are_refused(frame):
    model = fit_with_patience(frame, None, ["a", "b"], "y", dict(maxIter=2, maxDepth=2), 5).model
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="must not be"):
            models.predict(model, frame.withColumn("a", F.when(F.col("idx") > 3, F.col("a")).otherwise(F.lit(bad))), "p").collect()


@pytest.mark.parametrize("depth", [3, 8])
def test_permutation_scores_all_variants_together(frame, depth, monkeypatch):
    """The importances of one transform of all variants, without it."""
    model = fit_with_patience(frame, None, FEATURES, "y", dict(maxIter=6, maxDepth=depth, seed=3), 5).model
    def run():
        got = importance.permutation_importance(model, frame, FEATURES, "y", "idx", points_of=lambda c: F.greatest(F.col(c) if isinstance(c, str) else c, F.lit(0.1)))
        return {r.feature: (r.importance_mean, r.importance_std) for r in got.collect()}

    monkeypatch.setattr(tree_scores, "ensemble_of", lambda *a: None)
    want = run()
    monkeypatch.undo()
    monkeypatch.setattr(PipelineModel, "transform", None)
    got = run()
    assert got.keys() == want.keys() == set(FEATURES) and all(np.allclose(got[f], want[f], rtol=1e-9) for f in FEATURES)
    assert got["b"][0] > 1
