"""Predictions of tree ensembles, many rows at a time.

MLlib walks a row through one tree after the other as objects.  Here a task takes a batch's columns as arrays.  Every feature value becomes
the number of its bin between the model's split points; a tree is, for each feature that it splits, a table that tells for each
bin which leaves a row can still reach, as bits.  The bits that all its features leave are one: the row's leaf.  A tree with more than
``LEAVES`` leaves is walked level by level, all rows at once.

A row's prediction with one feature replaced looks up that feature's table again, in the trees that split it (``replaced``).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from demandflow.session import ensure_checkpoint_dir

#: Leaves that the bits of a number stand for, rows that are scored at a time, and ensembles that a Python worker keeps prepared
LEAVES, PIECE, KEPT = 64, 8192, 8
_PREPARED: dict = {}


class Ensemble:
    """trees: lists of (value, weight, gain, left, right, feature, threshold or left levels, levels) by node number, as
    ``histogram_trees`` packs them (left < 0: a leaf); a prediction is the sum of the trees' values times ``weights``."""

    def __init__(self, trees: list, weights: list[float], n_features: int):
        self.key, self.d = uuid.uuid4().hex, n_features
        points, self.levels = [set() for _ in range(n_features)], [0] * n_features
        for tree in trees:
            for _, _, _, left, _, f, at, levels in tree:
                if left >= 0 and levels >= 0:
                    self.levels[f] = max(self.levels[f], levels)
                elif left >= 0:
                    points[f].add(at[0])
        self.points = [np.array(sorted(p)) for p in points]
        place = [{v: i for i, v in enumerate(p)} for p in self.points]
        self.trees = []
        for tree, w in zip(trees, weights, strict=True):
            nodes = np.array([(left, right, f) for _, _, _, left, right, f, _, _ in tree], np.int32)
            cut = [at if left >= 0 and levels >= 0 else place[f][at[0]] if left >= 0 else None for _, _, _, left, _, f, at, levels in tree]
            self.trees.append((nodes, cut, np.array([w * node[0] for node in tree])))

    def bins(self, f: int) -> int:
        return self.levels[f] + 1 if self.levels[f] else len(self.points[f]) + 1

    def code(self, f: int, x: np.ndarray) -> np.ndarray:
        """Bins of the values of feature f: of numbers by the split points (at one: left of it); a nominal column's own levels, all others in the last."""
        if not self.levels[f]:
            return np.searchsorted(self.points[f], x, side="left")
        known = (x >= 0) & (x < self.levels[f]) & (x == np.floor(x))
        return np.where(known, x, self.levels[f]).astype(np.int64)

    def _goes_left(self, f: int, cut) -> np.ndarray:
        """Of each bin.  Levels that a split does not know go where MLlib sends them: away from the smaller side's list."""
        if not self.levels[f]:
            return np.arange(self.bins(f)) <= cut
        out = np.zeros(self.bins(f), bool)
        out[np.array(cut, np.int64)] = True
        out[-1] = len(cut) > self.levels[f] // 2
        return out

    def prepared(self) -> list:
        """Of each tree: (features, tables, leaf values) or, of a large one, (None, depth, what a walk needs)."""
        if self.key not in _PREPARED:
            while len(_PREPARED) >= KEPT:
                _PREPARED.pop(next(iter(_PREPARED)))
            _PREPARED[self.key] = [self._tables(*t) if (len(t[0]) + 1) // 2 <= LEAVES else self._walk(*t) for t in self.trees]
        return _PREPARED[self.key]

    def _tables(self, nodes: np.ndarray, cut: list, value: np.ndarray) -> tuple:
        leaves = [i for i in range(len(nodes)) if nodes[i, 0] < 0]
        below = {i: 1 << k for k, i in enumerate(leaves)}
        tables: dict = {}
        for i in range(len(nodes) - 1, -1, -1):  # children have larger numbers than their parents
            left, right, f = (int(v) for v in nodes[i])
            if left >= 0:
                below[i] = below[left] | below[right]
                lost = np.where(self._goes_left(f, cut[i]), np.uint64(below[right]), np.uint64(below[left]))
                tables[f] = tables.get(f, np.full(self.bins(f), np.uint64(2**64 - 1))) & ~lost
        features = sorted(tables)
        all_leaves = np.uint64(below[0])
        return features, [tables[f] & all_leaves for f in features], value[leaves]

    def _walk(self, nodes: np.ndarray, cut: list, value: np.ndarray) -> tuple:
        widest = max(self.bins(f) for f in range(self.d))
        below, right = np.arange(len(nodes)), np.zeros((len(nodes), widest), np.uint8)
        other = np.arange(len(nodes))
        depth, level = 0, [0]
        while level := [int(c) for i in level if nodes[i, 0] >= 0 for c in nodes[i, :2]]:
            depth += 1
        for i in range(len(nodes)):
            if nodes[i, 0] >= 0:
                below[i], other[i], f = nodes[i]
                right[i, :self.bins(f)] = ~self._goes_left(f, cut[i])
        return None, depth, (below, other, np.maximum(nodes[:, 2], 0).astype(np.int64), right.ravel(), widest, value)

    @staticmethod
    def _leaf(bits: np.ndarray) -> np.ndarray:
        """The place of the one bit of each."""
        return (bits.astype(np.float64).view(np.int64) >> 52) - 1023

    @staticmethod
    def _walked(codes: np.ndarray, depth: int, walk: tuple) -> np.ndarray:
        below, other, feature, right, widest, value = walk
        n = codes.shape[1]
        flat, each, at = codes.ravel(), np.arange(n), np.zeros(n, np.int64)
        for _ in range(depth):
            to_right = right.take(at * widest + flat.take(feature.take(at) * n + each))
            at = np.where(to_right, other.take(at), below.take(at))
        return value.take(at)

    def _codes(self, x: list) -> np.ndarray:
        return np.array([self.code(f, v) for f, v in enumerate(x)])

    def scores(self, x: list) -> np.ndarray:
        """Predictions of the rows of the features' arrays."""
        out = np.zeros(len(x[0]))
        for lo in range(0, len(out), PIECE):
            codes, total = self._codes([v[lo:lo + PIECE] for v in x]), out[lo:lo + PIECE]
            for features, tables, value in self.prepared():
                if features is None:
                    total += self._walked(codes, tables, value)
                elif features:
                    bits = tables[0].take(codes[features[0]])
                    for f, t in zip(features[1:], tables[1:], strict=True):
                        bits &= t.take(codes[f])
                    total += value.take(self._leaf(bits))
                else:
                    total += value[0]
        return out

    def replaced(self, x: list, other: list) -> np.ndarray:
        """(rows, features): predictions of the rows with the feature's value taken from ``other``."""
        out = np.zeros((len(x[0]), self.d))
        for lo in range(0, len(out), PIECE):
            codes, others = (self._codes([v[lo:lo + PIECE] for v in y]) for y in (x, other))
            total, more = np.zeros(codes.shape[1]), np.zeros(codes.shape)
            for features, tables, value in self.prepared():
                if features is None:
                    base = self._walked(codes, tables, value)
                    total += base
                    for f in {int(f) for f in np.unique(value[2])}:
                        kept, codes[f] = codes[f].copy(), others[f]
                        more[f] += self._walked(codes, tables, value) - base
                        codes[f] = kept
                elif features:
                    own = [t.take(codes[f]) for f, t in zip(features, tables, strict=True)]
                    after = [None] * len(own)  # what the features behind one leave
                    for i in range(len(own) - 1, 0, -1):
                        after[i - 1] = own[i] if after[i] is None else own[i] & after[i]
                    base = value.take(self._leaf(own[0] if after[0] is None else own[0] & after[0]))
                    total += base
                    before = None
                    for i, f in enumerate(features):
                        bits = tables[i].take(others[f])
                        for rest in (before, after[i]):
                            if rest is not None:
                                bits &= rest
                        more[f] += value.take(self._leaf(bits)) - base
                        before = own[i] if before is None else before & own[i]
                else:
                    total += value[0]
            out[lo:lo + PIECE] = (total + more).T
        return out


def _arrays(columns) -> list:
    """The batch's columns as arrays of numbers."""
    if any(c.null_count for c in columns):
        raise ValueError("features of a prediction must not be null")
    out = [c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in columns]
    if any(np.isnan(v).any() for v in out):
        raise ValueError("features of a prediction must not be NaN")
    return out


def ensemble_of(model: PipelineModel, df: DataFrame) -> Ensemble | None:
    """The trees of a pipeline of an assembler of df's numbers and a tree regression; None of any other."""
    stages = getattr(model, "stages", [])
    if len(stages) != 2 or not isinstance(stages[1], GBTRegressionModel | RandomForestRegressionModel) or stages[0].getHandleInvalid() != "error":
        return None
    if not all(isinstance(df.schema[f].dataType, NumericType) for f in stages[0].getInputCols()):
        return None
    if getattr(stages[1], "ensemble", None) is None:
        stages[1].ensemble = _read(stages[1], df.sparkSession)
    return stages[1].ensemble


def _read(last, spark) -> Ensemble:
    """From the format that MLlib saves."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/demandflow-scores/{uuid.uuid4().hex}"
    last.write().save(path)
    trees = [{} for _ in range(last.getNumTrees)]
    for r in spark.read.parquet(f"{path}/data").collect():  # at most some thousand nodes a tree
        n = r.nodeData
        trees[r.treeID][n.id] = (n.prediction, 0.0, n.gain, n.leftChild, n.rightChild, n.split.featureIndex, list(n.split.leftCategoriesOrThreshold), n.split.numCategories)
    weights = list(last.treeWeights) if isinstance(last, GBTRegressionModel) else [1.0 / len(trees)] * len(trees)
    return Ensemble([[t[i] for i in range(len(t))] for t in trees], weights, last.numFeatures)


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def predict(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """df and the model's prediction as column ``out``."""
    ensemble = ensemble_of(model, df)
    if ensemble is None:
        return model.transform(df).withColumnRenamed("prediction", out).drop("features")

    def scores(*columns: pa.Array) -> pa.Array:
        return pa.array(ensemble.scores(_arrays(columns)))

    return df.withColumn(out, F.arrow_udf(scores, "double")(*[_double(f) for f in model.stages[0].getInputCols()]))


def predict_replaced(model: PipelineModel, df: DataFrame, others: list[str], out: str) -> DataFrame:
    """df and, as array ``out``, the predictions with each of the model's features taken from its column of ``others`` (tree regressions only)."""
    ensemble = ensemble_of(model, df)

    def scores(*columns: pa.Array) -> pa.Array:
        x = _arrays(columns)
        found = ensemble.replaced(x[:ensemble.d], x[ensemble.d:])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * ensemble.d, pa.int32()), pa.array(found.ravel()))

    return df.withColumn(out, F.arrow_udf(scores, "array<double>")(*[_double(f) for f in [*model.stages[0].getInputCols(), *others]]))
