"""Trees grown from histograms: MLlib's own trees, one block or many, nominal columns, classifiers, forests."""

import pickle
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from demandflow.operators import fits, histogram_trees, models
from demandflow.operators.extra_trees import ExtraTrees


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    r = random.Random(11)
    rows = []
    for i in range(600):
        a, b, c = r.random(), float(r.randrange(5)), r.choice("uvwx")
        rows.append((i, a, b, c, float(a > 0.4) + 0.3 * b * (c in "ux") + r.gauss(0, 0.4)))
    path = str(tmp_path_factory.mktemp("trees") / "frame")
    df = spark.createDataFrame(rows, "idx long, a double, b double, c string, y double").withColumn("one", (F.col("y") > 0.8).cast("double"))
    StringIndexer(inputCol="c", outputCol="n", stringOrderType="alphabetAsc").fit(df).transform(df).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("idx").collect()])


@pytest.mark.parametrize("tasks", [1, 3])
def test_boosting_grows_the_trees_of_mllib(frame, tasks, monkeypatch):
    """Nominal columns and least rows, too; blocks of rows give the fit of one task, and a checkpoint on the way changes nothing."""
    monkeypatch.setattr(histogram_trees, "CHECKPOINT", 3)
    params = dict(maxIter=8, maxDepth=4, stepSize=0.2, minInstancesPerNode=7, seed=1)
    asm = VectorAssembler(inputCols=["a", "b", "n"], outputCol="features")
    want = Pipeline(stages=[asm, GBTRegressor(featuresCol="features", labelCol="y", **params)]).fit(frame)
    got = fits.fit_with_patience(frame, None, ["a", "b", "n"], "y", params, 50, tasks)
    assert np.allclose(predictions(got.model, frame), predictions(want, frame))
    assert got.model.stages[-1].getNumTrees == 8 and got.n_trees == got.n_fitted == 8
    assert np.allclose(got.model.stages[-1].featureImportances.toArray(), want.stages[-1].featureImportances.toArray())


def test_blocks_stop_where_one_task_does(frame):
    params = dict(maxIter=40, maxDepth=3, stepSize=0.3, seed=1)
    one, many = (fits.fit_with_patience(frame.where("idx % 4 > 0"), frame.where("idx % 4 = 0"), ["a", "b"], "y", params, 4, k) for k in (1, 4))
    assert one.n_trees == many.n_trees < 36 and one.error == pytest.approx(many.error) and one.n_fitted == many.n_fitted == one.n_trees + 4


def test_boosted_classifier_is_mllibs(frame):
    pipe = models.gbt_classifier(["a", "b"], "one", maxIter=6)
    want = pipe.fit(frame)
    assert isinstance(pipe.getStages()[-1], GBTClassifier)
    for tasks in (1, 2):
        got = models.positive_probability(models.fit_classifier(pipe, frame, tasks), frame)
        p = np.array([r.proba for r in got.orderBy("idx").collect()])
        assert np.allclose(p, [r.probability[1] for r in want.transform(frame).orderBy("idx").collect()])


@pytest.mark.parametrize("tasks", [1, 3])
def test_forest_classifier_tells_the_classes(frame, tasks):
    model = models.fit_classifier(models.forest_classifier(["a", "b"], "one", numTrees=12), frame, tasks)
    p = np.array([r.proba for r in models.positive_probability(model, frame).orderBy("idx").collect()])
    one = np.array([r.one for r in frame.orderBy("idx").collect()])
    assert model.stages[-1].getNumTrees == 12 and 0 <= p.min() and p.max() <= 1 and ((p > 0.5) == one).mean() > 0.75


def test_randomised_trees_do_not_depend_on_blocks(frame, monkeypatch):
    make = lambda: ExtraTrees(["a", "b"], "y", n_trees=4, max_depth=4, cuts=6, feature_share="all").fit(frame)
    one = make()
    monkeypatch.setattr(histogram_trees, "ROWS_PER_TASK", 200)
    many = make()
    assert np.allclose([r.pred for r in one.predict(frame).orderBy("idx").collect()], [r.pred for r in many.predict(frame).orderBy("idx").collect()])


def test_missing_values_and_no_rows(frame):
    for bad in (frame.withColumn("a", F.when(F.col("idx") > 3, F.col("a"))), frame.where("idx < 0")):
        with pytest.raises(Exception, match="null|no rows"):
            fits.fit_with_patience(bad, None, ["a"], "y", dict(maxIter=2), 5)


@pytest.mark.parametrize("limit", [1, 12, 2048])
def test_joined_features_count_as_each_by_itself(limit, monkeypatch):
    """Rows of all nodes or picked and weighted ones; a row is counted once for a group of features."""
    r = np.random.default_rng(5)
    splits = [np.arange(k - 1) + 0.5 for k in (3, 1, 7, 2, 4)]
    sizes = np.array([len(s) + 1 for s in splits])
    x, g, w = [r.integers(0, k, 500).astype(float) for k in sizes], r.normal(size=500), r.poisson(1.0, 500).astype(float)
    groups = histogram_trees.joined_features(sizes, limit)
    assert sorted(f for group in groups for f in group) == list(range(5)) and (len(groups) == 1) == (limit == 2048)
    codes = histogram_trees.joined_codes(x, splits, groups)
    monkeypatch.setattr(histogram_trees, "PIECE", 64)
    rows, node = np.flatnonzero(r.random(500) < 0.6), None
    for some, weight, m in ((None, None, 1), (rows, w, 3)):
        node = None if m == 1 else r.integers(0, m, len(rows))
        got = histogram_trees._histogram(some, node, m, codes, groups, sizes, g, weight)
        each, place, v = (np.arange(500), np.zeros(500, int), np.ones(500)) if m == 1 else (rows, node, w[rows])
        want = np.zeros_like(got)
        for f, at in enumerate(np.cumsum(sizes) - sizes):
            np.add.at(want[:, :, 0], (place, at + x[f][each].astype(int)), g[each] * v)
            np.add.at(want[:, :, 1], (place, at + x[f][each].astype(int)), v)
        assert np.allclose(got, want) and (got[:, :, 1] == want[:, :, 1]).all()


def test_validation_takes_no_pass_of_its_own():
    """A stopped fit asks the blocks once a level, and the first tree's root; the block after a tree is that of a route from the root."""
    r = np.random.default_rng(3)
    x, y = [r.random(300), r.integers(0, 4, 300).astype(float)], r.normal(size=300)
    spec = dict(loss="squared", n_trees=6, depth=3, step=0.3, subsample=0.7, max_bins=16, min_rows=1, min_gain=0.0, share="all", seed=1, patience=9, held=True, arity=[0, 0],
                bootstrap=False, cuts=None)
    splits = histogram_trees._splits([histogram_trees._told(x, 200, spec)], spec)

    class Counted(histogram_trees._Alone):
        asked = 0

        def ask(self, what):
            self.asked += 1
            return super().ask(what)

    class Afresh(Counted):
        """Every step on a block as another job gets it."""

        def ask(self, what):
            self.asked += 1
            return what(pickle.loads(pickle.dumps(self.block)))

    crews = [c(histogram_trees._Block(x, y, 200, 0, splits, spec)) for c in (Counted, Afresh)]
    (trees, errors), (same, again) = (histogram_trees._boost(c, splits, spec) for c in crews)
    assert trees == same and errors == again and len(errors) == 6
    assert all(c.asked == 6 * 3 + 1 for c in crews)
    assert np.allclose(crews[0].block.margin, crews[1].block.margin)


def test_thresholds_are_told_by_pieces_without_blocks(frame, monkeypatch):
    """Summaries of a few rows each give the split points of one task, and only the blocks are shuffled."""
    sizes, shuffles = [], []
    told, again = histogram_trees._splits, type(frame).repartition
    monkeypatch.setattr(histogram_trees, "_splits", lambda t, spec: sizes.extend(n for n, _ in t) or told(t, spec))
    monkeypatch.setattr(type(frame), "repartition", lambda df, *a: shuffles.append(a) or again(df, *a))
    grown = lambda tasks: histogram_trees.grow_trees(frame, None, ["a", "b"], "y", tasks, n_trees=3, depth=3)[0]
    monkeypatch.setattr(histogram_trees, "ROWS_PER_TASK", 100)
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        many = grown(2)
    finally:
        frame.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes == [100] * 6 and shuffles == [(2,)]
    for a, b in zip(grown(1), many, strict=True):
        assert len(a) == len(b) and all(np.allclose(p[:3], q[:3]) and p[3:6] == q[3:6] and np.allclose(p[6], q[6]) for p, q in zip(a, b, strict=True))


def test_few_rows_are_summed_feature_by_feature(monkeypatch):
    """Where splits tie, the order of the sums decides: a small block adds up every feature by itself, a large one joins them."""
    r = np.random.default_rng(8)
    x, y = [r.integers(0, 4, 400).astype(float) for _ in range(3)], r.normal(size=400)
    splits, spec = [np.arange(3) + 0.5] * 3, dict(loss="squared")
    small = histogram_trees._Block(list(x), y, 400, 0, splits, spec)
    monkeypatch.setattr(histogram_trees, "JOINT_ROWS", 400)
    large = histogram_trees._Block(list(x), y, 400, 0, splits, spec)
    assert len(small.groups) == 3 and len(large.groups) == 1
    got = histogram_trees._histogram(None, None, 1, small.codes, small.groups, small.sizes, y, None)
    for f in range(3):
        assert (got[0, 4 * f:4 * f + 4, 0] == np.bincount(x[f].astype(int), y)).all()
