"""A plan of model fits with early stopping by patience.

A query that needs many models (folds, presets, feature sets, trials) names them as ``Fit`` values, each keyed by what its
model depends on: the frame's contents, the predicates that choose its rows, features, label, parameters.  ``FitPlan``
does every distinct fit once, as many at a time as keep the cores busy, and keeps the fitted model and its
facts in a store under the checkpoint folder, so that a fit that some earlier query or an interrupted run finished is read
back.

Early stopping: Spark's own stops at the first round without gain; here a fit goes on until ``patience`` rounds in a row
have not beaten the best one, and the model is cut at the best.  The validation rows lie beside the training rows in the fit's tasks
(``histogram_trees``), which know the error of every prefix of the trees as soon as it is grown.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.operators.histogram_trees import as_model, grow_together, grow_trees, share_out, slots
from demandflow.session import ensure_checkpoint_dir

#: Rounds without a better validation error after which a fit stops, and large fits that grow together
PATIENCE, TOGETHER = 50, 12


class Store:
    """An append-only table of facts keyed by a text, under the checkpoint folder (or ``path``): rows survive the session's
    failure, and a second writer of a key does no harm (the first row by ``written`` counts).  Every row is written to a folder of
    its own, so that writers at the same time do not share a commit."""

    def __init__(self, spark: SparkSession, name: str, columns: str, path: str | None = None):
        self.spark, self.schema = spark, f"key string, {columns}, written timestamp"
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/demandflow-store/{name}"

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], self.schema)

    def rows(self, keys: list[str]) -> dict:
        """The stored rows of these keys."""
        found = self.table().where(F.col("key").isin(keys)).orderBy("written").collect()
        return {r.key: r for r in reversed(found)}

    def add(self, key: str, *values) -> None:
        self.spark.createDataFrame([(key, *values)], self.schema.rsplit(",", 1)[0]).withColumn("written", F.current_timestamp()) \
            .coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")


@dataclass(frozen=True)
class Fit:
    """A boosted regression on the frame's rows where ``rows``; ``valid`` (a predicate, too) tells when to stop."""

    rows: str
    features: tuple
    label: str
    params: tuple
    valid: str | None = None
    patience: int = PATIENCE

    @classmethod
    def of(cls, rows: str, features, label: str, params: dict, valid: str | None = None, patience: int = PATIENCE) -> Fit:
        return cls(rows, tuple(features), label, tuple(sorted(params.items())), valid, patience)


@dataclass
class Fitted:
    """model; n_trees; error: mean squared validation error at n_trees; n_fitted: rounds that were run in all."""

    model: PipelineModel
    n_trees: int
    error: float | None = None
    n_fitted: int = 0


def fingerprint(frame: DataFrame) -> tuple[int, str]:
    """(rows, a text equal for equal contents) in one pass; the order of rows and columns plays no part."""
    cols = sorted(frame.columns)
    r = frame.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return int(r.n), f"{r.n}:{r.h}:{','.join(cols)}"


def stopping_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """(best round, counted from 1; whether patience was used up) of the validation errors of rounds 1, 2, ...

    Rounds after the one that used patience up do not count, as if they had not been run."""
    best, at = float("inf"), 0
    for i, e in enumerate(errors, 1):
        if e < best:
            best, at = e, i
        elif i - at >= patience:
            return at, True
    return at, False


def boosting(params: dict) -> dict:
    """Parameters named as GBTRegressor's (its defaults for the others) as those of ``grow_trees``."""
    names = {"maxIter": "n_trees", "maxDepth": "depth", "stepSize": "step", "subsamplingRate": "subsample", "maxBins": "max_bins",
             "minInstancesPerNode": "min_rows", "minInfoGain": "min_gain", "featureSubsetStrategy": "share", "seed": "seed"}
    return {names[k]: v for k, v in params.items()}


def boosted_model(spark: SparkSession, trees: list, features, label: str, params: dict) -> PipelineModel:
    """An assembler and the boosted model of these trees."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    weights = [1.0] + [float(params.get("stepSize", 0.1))] * (len(trees) - 1)
    kept = {**params, "maxIter": len(trees), "featuresCol": "features", "labelCol": label, "predictionCol": "prediction"}
    return PipelineModel([assemble, as_model(spark, GBTRegressionModel, trees, weights, len(features), kept)])


def _cut(spark: SparkSession, trees: list, errors: list, features, label: str, params: dict, patience: int) -> Fitted:
    """The model of the trees up to the best round."""
    best = max(1, stopping_round(errors, patience)[0]) if errors else len(trees)
    return Fitted(boosted_model(spark, trees[:best], features, label, params), best, errors[best - 1] if errors else None, len(trees))


def fit_with_patience(train: DataFrame, valid: DataFrame | None, features, label: str, params: dict, patience: int = PATIENCE, tasks: int = 1) -> Fitted:
    """L4: the boosted model cut at its best round on ``valid`` (without one: all ``maxIter`` rounds)."""
    trees, errors = grow_trees(train, valid, features, label, tasks, **boosting(params), patience=patience)
    return _cut(train.sparkSession, trees, errors, features, label, params, patience)


@dataclass
class FitPlan:
    """Fits on one frame.  ``run`` does those that are not stored; the frame should be a written table."""

    frame: DataFrame
    name: str = "fits"
    parallel: int | None = None
    _done: dict = field(default_factory=dict)
    _print: tuple | None = None

    def _fingerprint(self) -> tuple[int, str]:
        if self._print is None:
            self._print = fingerprint(self.frame)
        return self._print

    def key(self, fit: Fit) -> str:
        return hashlib.sha256(json.dumps([self._fingerprint()[1], fit.rows, fit.features, fit.label, fit.params, fit.valid,
                                          fit.patience if fit.valid else 0]).encode()).hexdigest()

    def _rows(self, where: str | None) -> DataFrame | None:
        return None if where is None else self.frame.where(where)

    def run(self, fits: list[Fit]) -> list[Fitted]:
        """The fitted models, in the order asked for; fits on few rows lie side by side, those on many grow together on all cores."""
        spark = self.frame.sparkSession
        n, _ = self._fingerprint()
        store = Store(spark, self.name, "path string, n_trees int, error double, n_fitted int")
        todo = {self.key(f): f for f in fits}
        todo = {k: f for k, f in todo.items() if k not in self._done}
        stored = store.rows(list(todo)) if todo else {}
        tasks, _ = share_out(n, 1, slots(spark))
        at_a_time = slots(spark)

        def one(item):
            k, f = item
            if k in stored:
                r = stored[k]
                return k, Fitted(PipelineModel.load(r.path), r.n_trees, r.error, r.n_fitted)
            if k in grown:
                out = _cut(spark, *grown.pop(k), f.features, f.label, dict(f.params), f.patience)
            else:
                out = fit_with_patience(self._rows(f.rows), self._rows(f.valid), f.features, f.label, dict(f.params), f.patience, tasks)
            path = f"{store.path}-models/{uuid.uuid4().hex}"
            out.model.write().save(path)
            store.add(k, path, out.n_trees, out.error, out.n_fitted)
            return k, out

        missing, grown = [k for k in todo if k not in stored], {}
        with ThreadPoolExecutor(max_workers=self.parallel or at_a_time) as pool:
            if tasks == 1:
                self._done.update(pool.map(one, todo.items()))
            else:
                self._done.update(pool.map(one, [(k, f) for k, f in todo.items() if k in stored]))
                for lo in range(0, len(missing), TOGETHER):
                    some = {k: todo[k] for k in missing[lo:lo + TOGETHER]}
                    wanted = [(f.rows, f.valid, f.features, f.label, {**boosting(dict(f.params)), "patience": f.patience}) for f in some.values()]
                    grown.update(zip(some, grow_together(self.frame, wanted, tasks), strict=True))
                    self._done.update(pool.map(one, some.items()))
        return [self._done[self.key(f)] for f in fits]

    def fit(self, fit: Fit) -> Fitted:
        return self.run([fit])[0]
