"""Large fits that grow together from one reading: the trees of each fit alone, one job a level, files that are lost."""

import os
import random
import shutil

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from demandflow.operators import fits, histogram_trees, models
from demandflow.operators.histogram_trees import grow_together, grow_trees


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    r = random.Random(6)
    rows = [(i, r.random(), float(r.randrange(5)), r.random(), r.gauss(0, 1)) for i in range(700)]
    path = str(tmp_path_factory.mktemp("together") / "frame")
    spark.createDataFrame(rows, "idx long, a double, b double, c double, e double").withColumn("y", F.col("a") * F.col("b") + F.col("e") * 0.3) \
        .withColumn("c", F.when(F.col("idx") >= 20, F.col("c"))).write.parquet(path)
    return spark.read.parquet(path)


WANTED = [("idx % 4 > 0", "idx % 4 = 0", ["a", "b"], "y", dict(n_trees=30, depth=3, step=0.5, patience=4)), ("idx >= 20", None, ["b", "c", "a"], "y", dict(n_trees=5, depth=4)),
          ("idx >= 100", "idx >= 650", ["a"], "e", dict(n_trees=3, depth=2, max_bins=8))]


def same(one, two):
    (trees, errors), (more, others) = one, two
    assert len(trees) == len(more) and np.allclose(errors, others)
    for a, b in zip(trees, more, strict=True):
        assert len(a) == len(b) and all(np.allclose(p[:3], q[:3], atol=1e-9) and p[3:6] == q[3:6] and np.allclose(p[6], q[6]) for p, q in zip(a, b, strict=True))


def alone(frame, rows, valid, features, label, given):
    return grow_trees(frame.where(rows), None if valid is None else frame.where(valid), features, label, 1, **given)


def test_each_fit_is_that_of_one_task(frame):
    """Other rows, features, labels and numbers of trees; rows of both predicates; a column that is null where a fit does not look."""
    for got, wanted in zip(grow_together(frame, WANTED, 3), WANTED, strict=True):
        same(got, alone(frame, *wanted))


def test_a_job_answers_for_all_fits(frame, monkeypatch):
    """As many jobs as the fit with the most levels asks, and one reading."""
    asked, read = [], []
    answers, again = histogram_trees._Together._answers, type(frame).repartition
    monkeypatch.setattr(histogram_trees._Together, "_answers", lambda self, a: asked.append(len(a)) or answers(self, a))
    monkeypatch.setattr(type(frame), "repartition", lambda df, *a: read.append(a) or again(df, *a))
    wanted = [("idx >= 20", None, fs, "y", dict(n_trees=4, depth=3)) for fs in (["a"], ["a", "b"], ["a", "b", "c"], ["b", "a"])]
    grow_together(frame, wanted, 2)
    assert asked == [4] * 4 * 3 and read == [(2,)]


@pytest.mark.parametrize("always", [False, True])
def test_lost_files_are_made_again(frame, monkeypatch, always):
    """Between two jobs, or with every job as if tasks never stayed where their files are."""
    answers, jobs = histogram_trees._Together._answers, []

    def lossy(self, asked):
        jobs.append(1)
        if len(jobs) == 7:
            shutil.rmtree(os.path.join(SparkFiles.getRootDirectory(), f"demandflow-{self.name}"))
        return answers(self, asked)

    monkeypatch.setattr(histogram_trees._Together, "_answers", lossy)
    if always:
        monkeypatch.setattr(histogram_trees, "_answered", lambda *_: None)
    for got, wanted in zip(grow_together(frame, WANTED[:2], 2), WANTED[:2], strict=True):
        same(got, alone(frame, *wanted))
    assert len(jobs) > 7 and not [f for f in os.listdir(SparkFiles.getRootDirectory()) if f.startswith("demandflow-")]


def test_a_failure_ends_all_fits(frame):
    with pytest.raises(Exception, match="null or NaN"):
        grow_together(frame, [*WANTED, ("idx >= 0", None, ["c"], "y", dict(n_trees=2))], 2)
    with pytest.raises(ValueError, match="no rows"):
        grow_together(frame, [*WANTED, ("idx < 0", None, ["a"], "y", dict(n_trees=2))], 2)


def test_plan_grows_large_fits_together(frame, monkeypatch):
    """Groups of them; the models are those of small fits."""
    a = [fits.Fit.of("idx >= 20", fs, "y", dict(maxIter=3, maxDepth=3, seed=1), "idx % 4 = 0" if fs == ["a"] else None, 2) for fs in (["a"], ["b"], ["a", "b"])]
    some = frame.where("idx >= 20")
    want = fits.FitPlan(some, "together-small").run(a)
    groups, grow = [], fits.grow_together
    monkeypatch.setattr(histogram_trees, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(fits, "TOGETHER", 2)
    monkeypatch.setattr(fits, "grow_together", lambda f, w, tasks: groups.append(len(w)) or grow(f, w, tasks))
    got = fits.FitPlan(some, "together-large").run([*a, a[0]])
    assert groups == [2, 1] and got[0] is got[3] and [x.n_trees for x in got[:3]] == [x.n_trees for x in want]
    for x, y in zip(got, want, strict=False):
        p, q = (np.array([r.prediction for r in m.model.transform(some).orderBy("idx").collect()]) for m in (x, y))
        assert np.allclose(p, q)


def test_classifiers_of_folds_grow_together(frame, monkeypatch):
    """Boosted ones are those of each fold alone; all folds' fits are one reading."""
    f = frame.withColumn("one", (F.col("y") > 0.4).cast("double"))
    pipe, folds = models.gbt_classifier(["a", "b"], "one", maxIter=4), [f"idx % 3 <> {i}" for i in range(3)]
    want = models.fit_classifiers(pipe, f, folds, 1, 3)
    monkeypatch.setattr(models, "grow_trees", None)
    for x, y in zip(models.fit_classifiers(pipe, f, folds, 2), want, strict=True):
        p, q = (np.array([r.proba for r in models.positive_probability(m, f).orderBy("idx").collect()]) for m in (x, y))
        assert np.allclose(p, q)
    forests = models.fit_classifiers(models.forest_classifier(["a", "b"], "one", numTrees=6), f, folds, 2)
    assert [m.stages[-1].getNumTrees for m in forests] == [6] * 3
