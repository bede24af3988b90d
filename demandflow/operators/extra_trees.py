"""L2: extremely randomised trees.

Spark's forests look for the best of the same quantile thresholds in every tree.  Here each tree has cut points of its own, drawn evenly
between a feature's least and largest value from the tree's seed, and can only split at those (all rows, a random share of the features
at each node).  One aggregate gives all ranges; the trees are grown from histograms (``histogram_trees``), groups of them
side by side; together they are an MLlib forest, whose prediction is their mean.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators.histogram_trees import as_model, grow_trees, share_out, slots


@dataclass
class Tree:
    """cuts: each feature's cut points, rising; nodes: what ``grow_trees`` gives."""

    cuts: list[list[float]]
    nodes: list


def draw_cuts(ranges: list[tuple[float, float]], n: int, rng: random.Random) -> list[list[float]]:
    """n cut points of every feature, evenly drawn within its range; none for a constant one."""
    return [sorted({rng.uniform(lo, hi) for _ in range(n)}) if lo < hi else [] for lo, hi in ranges]


class ExtraTrees:
    """Regression by randomised trees: ``fit`` and ``predict``; features must not be null."""

    def __init__(self, features: list[str], label: str, n_trees: int = 100, max_depth: int = 10, cuts: int = 24, feature_share: str = "onethird",
                 min_rows: int = 2, seed: int = 42):
        self.features, self.label, self.n_trees, self.max_depth, self.cuts = list(features), label, n_trees, max_depth, cuts
        self.feature_share, self.min_rows, self.seed = feature_share, min_rows, seed
        self.trees: list[Tree] = []

    def fit(self, train: DataFrame) -> ExtraTrees:
        spark = train.sparkSession
        row = train.agg(F.count(F.lit(1)).alias("n"), *[e for i, f in enumerate(self.features) for e in (F.min(f).alias(f"lo{i}"), F.max(f).alias(f"hi{i}"))]).first()
        ranges = [(float(row[f"lo{i}"] or 0.0), float(row[f"hi{i}"] or 0.0)) for i in range(len(self.features))]
        places = slots(spark)
        tasks, at_a_time = share_out(int(row.n), self.n_trees, places)
        if tasks > 1:  # blocks keep the values themselves here: smaller ones, of one group at a time
            tasks, at_a_time = tasks * 8, 1
        cuts = [draw_cuts(ranges, self.cuts, random.Random(f"{self.seed}/{t}")) for t in range(self.n_trees)]

        def some(numbers):
            return grow_trees(train, None, self.features, self.label, tasks, loss="forest", numbers=numbers, cuts=[cuts[t] for t in numbers], depth=self.max_depth,
                              share=self.feature_share, min_rows=self.min_rows, seed=self.seed)[0]

        groups = [list(range(at, self.n_trees, at_a_time)) for at in range(min(at_a_time, self.n_trees))]
        with ThreadPoolExecutor(max_workers=at_a_time) as pool:
            grown = {t: nodes for numbers, trees in zip(groups, pool.map(some, groups), strict=True) for t, nodes in zip(numbers, trees, strict=True)}
        self.trees = [Tree(cuts[t], grown[t]) for t in range(self.n_trees)]
        return self

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """df plus the mean of the trees' predictions."""
        assemble = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="error")
        forest = as_model(df.sparkSession, RandomForestRegressionModel, [t.nodes for t in self.trees], [1.0] * len(self.trees), len(self.features),
                          {"numTrees": len(self.trees), "featuresCol": "_features", "predictionCol": out})
        return PipelineModel([assemble, forest]).transform(df).drop("_features")
