"""Trees grown from histograms of binned rows.

MLlib walks all rows as objects for every level of every tree.  Here a task keeps its rows as one small number a feature (the bin) in
numpy arrays, and what leaves it for a level of a tree are histograms: rows and sum of the target in each bin of each node, of two sister
nodes only the smaller one's (the other one's is the difference).  Their size goes by nodes and bins, not by rows.

A block keeps its features joined: those with few bins share one number a row, so that a row is counted a few times a level and not once a feature, and that is all of it
that goes on from job to job beside label and prediction.

A fit on few rows (``ROWS_PER_TASK``) is one task that does all of it.  A larger one is an RDD of blocks of rows: a job for each level adds
up the blocks' histograms, the driver picks the splits, and with each finished tree the blocks' predictions move on.  The blocks lie in files beside
the tasks (``_Files``), and so do their predictions and the nodes that their rows have come to, so that a job moves nothing but trees and histograms and a
level routes rows by one step; what is lost is made again from the rows and the trees so far.  Trees with split points of their own go on from blocks in a
persisted RDD (``_Spread``).  Fits on one frame grow together (``_Together``): a job reads their blocks, and a job answers for a level of all of them.  The validation error of a tree comes with the first histogram of the next one.

The trees are those of MLlib: thresholds halfway between values or at quantiles (``maxBins``), nominal columns split by the
order of their levels' means, variance gain, ``minInstancesPerNode``, ``minInfoGain``, boosting by pseudo-residuals (the first
tree fits the label itself with weight 1).  Which rows and features a seed draws differs from MLlib; rows are sorted in their block
before they are drawn.  The result is an MLlib model, written in its own format.
"""

from __future__ import annotations

import contextlib
import copy
import functools
import gc
import glob
import json
import math
import os
import pickle
import shutil
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, StorageLevel, TaskContext
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandflow.operators.tree_scores import Ensemble
from demandflow.session import ensure_checkpoint_dir

#: Values of a feature that a task tells of for the thresholds: all up to so many, evenly spaced ranks of its rows beyond
SUMMARY = 10_000
#: Most rows of a block
ROWS_PER_TASK = 1_000_000
#: Rows that a task counts at a time
PIECE = 1 << 15
#: Steps after which blocks of a persisted RDD are checkpointed, and large fits that run side by side
CHECKPOINT, AT_A_TIME = 40, 4
#: Bytes of a level's histograms up to which the driver adds up the blocks' answers itself
TO_DRIVER = 64 << 20
#: Most bins that features share while rows are counted, and training rows of a block from which on they do: sums of joined features round differently, and
#: on few rows, where many splits gain the same, that decides between them
JOINT, JOINT_ROWS = 2048, 100_000

_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, "
          "rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


# --- what a task does -----------------------------------------------------------------------------------

def summary(values: np.ndarray, limit: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """(rising values, weights): the distinct ones and their rows, or evenly spaced ranks if there are more than ``limit``."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) <= limit:
        return distinct, counts.astype(float)
    at = ((np.arange(limit) + 0.5) * len(values) / limit).astype(np.int64)
    distinct, ranks = np.unique(np.repeat(distinct, counts)[at], return_counts=True)
    return distinct, ranks * (len(values) / limit)


def thresholds(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """Split points of a feature: between all neighbours if they fit, else where the weight passes equal shares (as MLlib's)."""
    if len(values) < 2:
        return np.zeros(0)
    if len(values) <= max_bins:
        return (values[:-1] + values[1:]) / 2
    share = weights.sum() / max_bins
    out, target, so_far = [], share, weights[0]
    for i in range(1, len(values)):
        before, so_far = so_far, so_far + weights[i]
        if abs(before - target) < abs(so_far - target):
            out.append((values[i - 1] + values[i]) / 2)
            target += share
    return np.array(out[:max_bins - 1])


def features_per_node(strategy: str, d: int) -> int:
    """How many of d features a node looks at (the names and numbers of ``featureSubsetStrategy``)."""
    if strategy in ("all", "auto"):
        return d
    if strategy in ("sqrt", "log2", "onethird"):
        return max(1, math.ceil({"sqrt": math.sqrt(d), "log2": math.log2(d), "onethird": d / 3.0}[strategy]))
    number = float(strategy)
    return min(d, int(number)) if number > 1 or strategy == "1" else max(1, math.ceil(number * d))


def joined_features(sizes, limit: int) -> list[list[int]]:
    """Features in groups whose bins multiply to at most ``limit`` (a larger one stands alone), the largest first."""
    groups, products = [], []
    for f in sorted(range(len(sizes)), key=lambda f: (-int(sizes[f]), f)):
        for i, p in enumerate(products):
            if p * int(sizes[f]) <= limit:
                groups[i].append(f)
                products[i] *= int(sizes[f])
                break
        else:
            groups.append([f])
            products.append(int(sizes[f]))
    return groups


def joined_codes(x: list, splits: list, groups: list[list[int]]) -> np.ndarray:
    """(groups, rows): a number for each row that stands for its bins of all features of the group, the last feature's bin counting ones."""
    widths = [math.prod(len(splits[f]) + 1 for f in group) for group in groups]
    out = np.zeros((len(groups), len(x[0])), np.uint16 if max(widths) <= 1 << 16 else np.int32)
    for code, group in zip(out, groups, strict=True):
        for f in group:
            code *= code.dtype.type(len(splits[f]) + 1)
            code += np.searchsorted(splits[f], x[f], side="left").astype(code.dtype)
    return out


def _histogram(rows: np.ndarray | None, node: np.ndarray | None, n_nodes: int, codes: np.ndarray, groups: list[list[int]], sizes: np.ndarray, g: np.ndarray,
               w: np.ndarray | None) -> np.ndarray:
    """(nodes, all features' bins, 2): sum of the target and weight of the rows' bins; ``rows`` picks them (None: all), ``node`` is theirs (None: all are of the
    one node).  Rows are counted once for a group of features, by pieces that stay in the processor's cache, and the group's counts are added up for each feature."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros((n_nodes, int(starts[-1]), 2))
    widths = [math.prod(int(sizes[f]) for f in group) for group in groups]
    joint = [np.zeros((2, n_nodes * k)) for k in widths]
    n = len(g) if rows is None else len(rows)
    for lo in range(0, n, PIECE):
        some = slice(lo, lo + PIECE) if rows is None else rows[lo:lo + PIECE]
        target, weight = g[some], None if w is None else w[some]
        if weight is not None:
            target = target * weight
        place = None if node is None else node[lo:lo + PIECE]
        for code, k, total in zip(codes, widths, joint, strict=True):
            at = code[some].astype(np.int64)
            if place is not None:
                at += place * k
            total[0] += np.bincount(at, target, n_nodes * k)
            total[1] += np.bincount(at, weight, n_nodes * k)
    for group, total in zip(groups, joint, strict=True):
        total = total.reshape(2, n_nodes, *[int(sizes[f]) for f in group])
        for i, f in enumerate(group):
            rest = tuple(2 + j for j in range(len(group)) if j != i)
            out[:, starts[f]:starts[f + 1]] = np.moveaxis(total.sum(axis=rest) if rest else total, 0, -1)
    return out


def _best_splits(hist: np.ndarray, sizes: np.ndarray, nominal: np.ndarray, spec: dict, keys: list) -> tuple:
    """Of each node: (gain, feature, left bins as a mask over the feature's bins, sum and weight on the left); gain 0: none."""
    n_nodes = len(hist)
    total = hist[:, :sizes[0]].sum(axis=1)
    s, n = total[:, :1], total[:, 1:]
    widest = int(sizes.max())
    gain, feature = np.zeros(n_nodes), np.zeros(n_nodes, np.int64)
    left, left_sum, left_n = np.zeros((n_nodes, widest), bool), np.zeros(n_nodes), np.zeros(n_nodes)
    allowed = np.ones((n_nodes, len(sizes)), bool)
    pick = features_per_node(spec["share"], len(sizes))
    if pick < len(sizes):
        allowed[:] = False
        for i, key in enumerate(keys):
            allowed[i, np.random.default_rng(key).permutation(len(sizes))[:pick]] = True
    at = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for f, k in enumerate(sizes):
            if k > 1:
                part = hist[:, at:at + k]
                order = None
                if nominal[f]:
                    mean = np.where(part[:, :, 1] > 0, part[:, :, 0] / part[:, :, 1], np.inf)
                    order = np.argsort(mean, axis=1, kind="stable")
                    part = np.take_along_axis(part, order[:, :, None], axis=1)
                run = np.cumsum(part, axis=1)[:, :-1]
                ls, ln = run[:, :, 0], run[:, :, 1]
                rs, rn = s - ls, n - ln
                least = max(spec["min_rows"], 1e-9)
                g = np.where((ln >= least) & (rn >= least), (ls * ls / ln + rs * rs / rn - s * s / n) / n, -1.0)
                best = g.argmax(axis=1)
                value = g[np.arange(n_nodes), best]
                better = allowed[:, f] & (value > gain) & (value >= spec["min_gain"])
                if better.any():
                    i = np.flatnonzero(better)
                    gain[i], feature[i], left_sum[i], left_n[i] = value[i], f, ls[i, best[i]], ln[i, best[i]]
                    mask = np.arange(k)[None, :] <= best[i][:, None]
                    left[i] = False
                    if order is None:
                        left[i, :k] = mask
                    else:
                        rows, cols = np.nonzero(mask)
                        left[i[rows], order[i[rows], cols]] = True
            at += k
    return gain, feature, left, left_sum, left_n


class _Growing:
    """A tree as lists by node number; depth: levels that are split; starts: the first node of each level."""

    def __init__(self):
        self.feature, self.left, self.children, self.value, self.weight, self.gain, self.depth, self.starts = [], [], [], [], [], [], 0, [0]

    def add(self, value, weight) -> int:
        for column, x in ((self.feature, 0), (self.left, None), (self.children, -1), (self.value, value), (self.weight, weight), (self.gain, -1.0)):
            column.append(x)
        return len(self.feature) - 1

    def route(self, block: _Block, some: slice, at: np.ndarray, depth: int) -> np.ndarray:
        """The nodes of the block's rows ``some``, which are at ``at`` on level ``depth`` or in a leaf, on the tree's last level; rows in leaves stay."""
        n, below, group = block.codes.shape[1], np.arange(len(self.feature)), np.zeros(len(self.feature), np.int64)
        right = np.zeros((len(self.feature), block.widest), np.uint8)
        parents = {}
        for i in range(self.starts[depth], len(self.feature)):
            if self.children[i] >= 0:
                below[i], group[i] = self.children[i], block.place[self.feature[i]][0] * n
                parents.setdefault(self.feature[i], []).append(i)
        for f, nodes in parents.items():
            of = block.place[f][1]
            right[nodes, :len(of)] = ~np.array([self.left[i] for i in nodes])[:, of]
        codes, right = block.codes.reshape(-1), right.ravel()
        out = np.empty(len(at), at.dtype)
        for lo in range(0, len(at), PIECE):
            now = at[lo:lo + PIECE].astype(np.int64)
            each = np.arange(some.start + lo, some.start + lo + len(now))
            for _ in range(self.depth - depth):
                now = below.take(now) + right.take(now * block.widest + codes.take(group.take(now) + each))
            out[lo:lo + PIECE] = now
        return out


class _Block:
    """Binned rows (training rows first, ``n`` of them) and what the trees so far predict for them."""

    def __init__(self, x: list, y: np.ndarray, n: int, index: int, splits: list | None, spec: dict):
        self.x, self.y, self.n, self.index = x, y, n, index
        self.margin, self.tree, self.kept = np.zeros(len(y)), None, None
        if splits is not None:
            self.cut(splits)
            self.x = None
        if spec["loss"] == "logistic":
            self.y = 2.0 * y - 1.0

    def cut(self, splits: list) -> None:
        self.sizes = np.array([len(s) + 1 for s in splits])
        self.groups = joined_features(self.sizes, JOINT if self.n >= JOINT_ROWS else 1)
        self.codes = joined_codes(self.x, splits, self.groups)
        self._prepare()

    def _prepare(self) -> None:
        """What follows from the groups: widest one's bins; of each feature its group and its own bin for each of the group's."""
        self.widest, self.place = 1, {}
        for i, group in enumerate(self.groups):
            width = math.prod(int(self.sizes[f]) for f in group)
            self.widest, ones = max(self.widest, width), width
            for f in group:
                ones //= int(self.sizes[f])
                self.place[f] = (i, np.arange(width) // ones % int(self.sizes[f]))

    def begin(self, t: int, spec: dict) -> None:
        """Target, rows and weights of tree t."""
        y, margin, draw = self.y[:self.n], self.margin[:self.n], np.random.default_rng((spec["seed"], t, self.index))
        self.tree, self.at, self.depth, self.used, self.w = t, self._roots(self.n, spec["depth"]), 0, None, None
        if self.kept is not None and self.kept[0] == t:
            _, self.depth, self.at = self.kept
        if spec["loss"] == "forest" or t == 0:
            self.g = y
        else:
            self.g = 4.0 * y / (1.0 + np.exp(2.0 * y * margin)) if spec["loss"] == "logistic" else 2.0 * (y - margin)
        if spec["bootstrap"]:
            self.w = draw.poisson(1.0, self.n).astype(float)
            self.used = np.flatnonzero(self.w)
        elif spec["subsample"] < 1.0:
            self.used = np.flatnonzero(draw.random(self.n) < spec["subsample"])

    @staticmethod
    def _roots(n: int, depth: int) -> np.ndarray:
        """Node numbers of rows that are at the root of a tree of so many levels."""
        return np.zeros(n, np.uint16 if depth < 15 else np.int64)

    def histograms(self, t: int, tree: _Growing | None, nodes: list, spec: dict) -> np.ndarray:
        """Those of the nodes (``tree`` None: of the root) in tree t as far as it is grown."""
        if self.tree != t:
            self.begin(t, spec)
        codes = self.codes[:, :self.n]
        if tree is None:
            return _histogram(self.used, None, 1, codes, self.groups, self.sizes, self.g, self.w)
        self.at, self.depth = tree.route(self, slice(0, self.n), self.at, self.depth), tree.depth
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        mine = place[self.at if self.used is None else self.at[self.used]]
        some = np.flatnonzero(mine >= 0)
        return _histogram(some if self.used is None else self.used[some], mine[some], len(nodes), codes, self.groups, self.sizes, self.g, self.w)

    def advance(self, tree: _Growing, scale: float) -> _Block:
        """The block after a finished tree: its training rows go on from where the last histograms left them."""
        value = np.array(tree.value) * scale
        if self.tree is not None:
            at, depth = self.at, self.depth
        elif self.kept is not None:
            _, depth, at = self.kept
        else:
            at, depth = self._roots(self.n, tree.depth), 0
        at = tree.route(self, slice(0, self.n), at, depth)
        held = tree.route(self, slice(self.n, len(self.y)), self._roots(len(self.y) - self.n, tree.depth), 0)
        self.margin = self.margin + np.concatenate([value[at], value[held]])
        self.tree = self.kept = None
        return self

    def held_error(self) -> np.ndarray:
        return np.array([((self.y[self.n:] - self.margin[self.n:]) ** 2).sum(), float(len(self.y) - self.n)])

    def __getstate__(self):
        """What goes on to other jobs: without the arrays that follow from the rest."""
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "at", "used", "g", "w")} | {"tree": None, "kept": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        if hasattr(self, "codes"):
            self._prepare()


class _Alone:
    """One block in its own task."""

    def __init__(self, block: _Block):
        self.first = self.block = block

    def ask(self, what):
        return what(self.block)

    def then(self, what) -> None:
        self.block = what(self.block)

    def afresh(self, what) -> None:
        self.block = what(self.first)


class _Spread:
    """Blocks of many tasks as a persisted RDD of one block a partition."""

    def __init__(self, blocks):
        self.first = self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)
        self.steps, self.saved, self.old = 0, [], None

    def ask(self, what):
        """The sum of the blocks' answers."""
        answers = self.blocks.map(what)
        if answers.getNumPartitions() > 64:
            out = answers.treeReduce(lambda a, b: a + b)
        else:
            parts = answers.collect()  # one small array a block
            out = parts[0]
            for p in parts[1:]:
                out = out + p
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return out

    def _go(self, blocks) -> None:
        if self.blocks is not self.first:
            self.old = self.blocks
        self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK_DESER)

    def then(self, what) -> None:
        self._go(self.blocks.map(what))
        self.steps += 1
        if self.steps % CHECKPOINT == 0:
            self.blocks.checkpoint()
            self.saved.append(self.blocks)

    def afresh(self, what) -> None:
        """As ``then``, but from the blocks as they were at the start."""
        self._go(self.first.map(what))

    def close(self) -> None:
        for b in (self.first, self.old, self.blocks):
            if b is not None:
                b.unpersist()
        for b in self.saved:
            if b.getCheckpointFile():
                path = b.ctx._jvm.org.apache.hadoop.fs.Path(b.getCheckpointFile())
                path.getFileSystem(b.ctx._jsc.hadoopConfiguration()).delete(path, True)


class _Files:
    """A block's files on the host of its task: what stays, the predictions after so many steps, the nodes of rows in the tree that is grown."""

    def __init__(self, crew: str, fit: int, index: int):
        self.base = os.path.join(SparkFiles.getRootDirectory(), f"demandflow-{crew}", f"{fit}.{index}")

    def _write(self, name: str, array: np.ndarray) -> None:
        """Whole or not at all, whoever writes the same at the same time."""
        part = f"{self.base}.{name}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{self.base}.{name}.npy")

    def _read(self, name: str) -> np.ndarray:
        return np.asarray(np.load(f"{self.base}.{name}.npy", mmap_mode="r"))

    def _drop(self, names: str, but: str) -> None:
        for path in glob.glob(f"{glob.escape(self.base)}.{names}-*.npy"):
            if path != f"{self.base}.{but}.npy":
                with contextlib.suppress(FileNotFoundError):
                    os.remove(path)

    def create(self, block: _Block, step: int) -> None:
        os.makedirs(os.path.dirname(self.base), exist_ok=True)
        rest = {k: v for k, v in block.__getstate__().items() if k not in ("codes", "y", "margin")}
        for name in ("codes", "y"):
            self._write(name, getattr(block, name))
        self._write("rest", np.frombuffer(pickle.dumps(rest), np.uint8))
        self._write(f"margin-{step}", block.margin)

    def load(self, step: int) -> _Block | None:
        """The block after so many steps, None if it is not here."""
        block = object.__new__(_Block)
        try:
            state = pickle.loads(self._read("rest").tobytes())
            state |= {"codes": self._read("codes"), "y": self._read("y"), "margin": self._read(f"margin-{step}")}
            at = glob.glob(f"{glob.escape(self.base)}.at-{step}-*.npy")
            if at:
                t, depth = max(tuple(map(int, path[:-4].split("-")[-2:])) for path in at)
                state["kept"] = t, depth, self._read(f"at-{step}-{t}-{depth}")
        except FileNotFoundError:
            return None
        block.__setstate__(state)
        return block

    def answer(self, what, since: int, steps: list):
        """what(the block after ``steps``, which follow on step ``since``), None if it is not here; the block's files go on."""
        last = since + len(steps)
        block = self.load(last)
        if block is None:
            block = self.load(since)
            if block is None:
                return None
            for step in steps:
                block = step(block)
            self._write(f"margin-{last}", block.margin)
            self._drop("margin", f"margin-{last}")
        out = what(block)
        if block.tree is not None and block.depth and (block.kept is None or block.kept[:2] != (block.tree, block.depth)):
            name = f"at-{last}-{block.tree}-{block.depth}"
            self._write(name, block.at)
            self._drop("at", name)
        return out


class _Together:
    """Fits that grow side by side: a job answers what all of them ask.  Their blocks are kept in files beside the tasks, and the RDD of the
    blocks' numbers leads a job to where they are.  ``rows`` is read in ``tasks`` blocks; ``build`` makes of a block's batches the fits' (fit, block)."""

    def __init__(self, rows: DataFrame, tasks: int, build, fits: int):
        self.rows, self.build, self.name = rows.repartition(tasks), build, uuid.uuid4().hex
        self.members = [_Filed(self, j) for j in range(fits)]
        self.active, self.asked, self.turn = fits, {}, threading.Condition()
        self._create()

    def _create(self) -> None:
        """Makes all files from the rows and the steps so far."""
        def create(batches, build=self.build, name=self.name, steps=[tuple(m.steps) for m in self.members]):
            index = TaskContext.get().partitionId()
            for j, block in build(batches):
                for step in steps[j]:
                    block = step(block)
                _Files(name, j, index).create(block, len(steps[j]))
                del block
            yield _record(index)

        self.numbers = self.rows.mapInArrow(create, "data binary").rdd.map(lambda r: pickle.loads(r.data)).persist(StorageLevel.MEMORY_AND_DISK)
        self.numbers.count()
        for m in self.members:
            m.done = len(m.steps)

    def _answers(self, asked: dict) -> list:
        """The sums of the blocks' answers to each member's question."""
        for again in (False, True):
            if again:
                self.numbers.unpersist()
                self._create()
            each = [(m.fit, what, m.done, m.steps[m.done:]) for m, what in asked.items()]
            out = self._sum(self.numbers.map(lambda index, name=self.name, each=each: _answered(name, index, each)), asked)
            if out is not None:
                break
        else:  # tasks do not stay where their files are
            def afresh(batches, build=self.build, each={m.fit: (what, tuple(m.steps)) for m, what in asked.items()}):
                out = {}
                for j, block in build(batches):
                    if j in each:
                        for step in each[j][1]:
                            block = step(block)
                        out[j] = each[j][0](block)
                yield _record([out[j] for j in each])

            out = self._sum(self.rows.mapInArrow(afresh, "data binary").rdd.map(lambda r: pickle.loads(r.data)), asked)
        for m in asked:
            m.done = len(m.steps)
        return out

    @staticmethod
    def _sum(answers, asked: dict) -> list | None:
        """None if one is missing."""
        def add(a, b):
            return None if a is None or b is None else [x + y for x, y in zip(a, b, strict=True)]

        if answers.getNumPartitions() * sum(m.expected for m in asked) > TO_DRIVER:
            return answers.treeReduce(add)
        return functools.reduce(add, answers.collect())

    def ask(self, member, what):
        """The answer to a member's question: the last one to ask runs the job for all of them."""
        with self.turn:
            self.asked[member] = what
            self._run_if_all()
            while member in self.asked:
                self.turn.wait()
            if member.failed is not None:
                raise member.failed
            return member.answer

    def leave(self) -> None:
        with self.turn:
            self.active -= 1
            self._run_if_all()

    def _run_if_all(self) -> None:
        if not self.asked or len(self.asked) < self.active:
            return
        try:
            for m, answer in zip(self.asked, self._answers(self.asked), strict=True):
                m.answer = answer
        except Exception as e:  # every member's thread ends by it
            for m in self.asked:
                m.failed = e
        self.asked = {}
        self.turn.notify_all()

    def run(self, work) -> list:
        """work(j, member) of all fits side by side, in their order."""
        def one(j):
            try:
                return work(j, self.members[j])
            finally:
                self.leave()

        try:
            with ThreadPoolExecutor(max_workers=len(self.members)) as pool:
                return list(pool.map(one, range(len(self.members))))
        finally:
            self._close()

    def _close(self) -> None:
        name = self.name
        with contextlib.suppress(Exception):  # else they go with the application
            self.numbers.foreach(lambda index: shutil.rmtree(os.path.dirname(_Files(name, 0, index).base), ignore_errors=True))
        self.numbers.unpersist()


def _answered(name: str, index: int, each: list) -> list | None:
    if not gc.get_freeze_count():  # a worker looks through all that it holds after every task: modules, for the most part
        gc.collect()
        gc.freeze()
    out = [_Files(name, j, index).answer(what, since, steps) for j, what, since, steps in each]
    return None if any(x is None for x in out) else out


class _Filed:
    """One of the fits that grow together; ``expected``: bytes of a block's next answer."""

    def __init__(self, together: _Together, fit: int):
        self.together, self.fit, self.steps, self.done, self.expected, self.answer, self.failed = together, fit, [], 0, 0, None, None

    def ask(self, what):
        return self.together.ask(self, what)

    def then(self, what) -> None:
        self.steps.append(what)


class _Pair(tuple):
    """Two answers that are added up each by itself."""

    def __new__(cls, *both):
        return super().__new__(cls, both)

    def __add__(self, other):
        return _Pair(self[0] + other[0], self[1] + other[1])

    def __reduce__(self):
        return _Pair, tuple(self)


def _grow(crew, t: int, sizes: np.ndarray, nominal: np.ndarray, spec: dict, hist: np.ndarray | None = None) -> _Growing:
    """Tree t; ``hist``: its root's histogram, if known."""
    tree = _Growing()
    if hist is None:
        hist = crew.ask(lambda b: b.histograms(t, None, [], spec))
    total = hist[0, :sizes[0]].sum(axis=0)
    tree.add(total[0] / total[1] if total[1] else 0.0, total[1])
    level = np.array([0])
    for depth in range(spec["depth"]):
        gain, feature, left, left_sum, left_n = _best_splits(hist, sizes, nominal, spec, [(spec["seed"], t, int(i)) for i in level])
        total = hist[:, :sizes[0]].sum(axis=1)
        parents = np.flatnonzero(gain > 0)
        start = len(tree.feature)
        if not len(parents):
            break
        small, sisters = [], []
        for i in parents:
            node, right = level[i], total[i] - (left_sum[i], left_n[i])
            tree.feature[node], tree.left[node], tree.gain[node] = int(feature[i]), left[i, :sizes[feature[i]]].copy(), gain[i]
            a = tree.add(left_sum[i] / left_n[i], left_n[i])
            b = tree.add(right[0] / right[1], right[1])
            tree.children[node] = a
            small.append(a if left_n[i] <= right[1] else b)
            sisters.append(b if left_n[i] <= right[1] else a)
        tree.depth = depth + 1
        tree.starts.append(start)
        if depth + 1 == spec["depth"]:
            break
        crew.expected = len(small) * int(sizes.sum()) * 16  # bytes of a block's answer
        own = crew.ask(lambda b, tree=tree, small=small: b.histograms(t, tree, small, spec))
        hist = np.concatenate([own, hist[parents] - own])
        hist[hist[:, :, 1] < 0.5, :] = 0.0
        level = np.array(small + sisters)
        # nodes in the order of their numbers, whichever was the smaller
        order = np.argsort(level)
        hist, level = hist[order], level[order]
    return tree


def _packed(tree: _Growing, splits: list, nominal, arity) -> dict:
    """The tree by MLlib's node numbers (preorder)."""
    order, stack = [], [0]
    while stack:
        i = stack.pop()
        order.append(i)
        if tree.children[i] >= 0:
            stack += [tree.children[i] + 1, tree.children[i]]
    number = {i: k for k, i in enumerate(order)}
    rows = []
    for i in order:
        f, child = tree.feature[i], tree.children[i]
        if child < 0:
            left, points, levels = -1, [], -1
        elif nominal[f]:
            left, points, levels = number[child], [float(x) for x in np.flatnonzero(tree.left[i])], int(arity[f])
        else:
            left, points, levels = number[child], [float(splits[f][int(tree.left[i].sum()) - 1])], -1
        rows.append((float(tree.value[i]), float(tree.weight[i]), float(tree.gain[i]), left, -1 if child < 0 else number[child + 1], f, points, levels))
    return rows


def _splits(told: list, spec: dict) -> list:
    """Split points of each feature from the blocks' summaries (rows, summary of each feature)."""
    total = sum(n for n, _ in told)
    if not total:
        raise ValueError("no rows to fit on")
    out = []
    for f, levels in enumerate(spec["arity"]):
        if levels:
            if levels > spec["max_bins"]:
                raise ValueError(f"maxBins {spec['max_bins']} is less than the {levels} levels of feature {f}")
            out.append(np.arange(levels - 1) + 0.5)
            continue
        values, place = np.unique(np.concatenate([each[f][0] for _, each in told]), return_inverse=True)
        out.append(thresholds(values, np.bincount(place, np.concatenate([each[f][1] for _, each in told]), len(values)), min(spec["max_bins"], total)))
    return out


def _told(x: list, n: int, spec: dict) -> tuple:
    return n, [None if spec["arity"][f] else summary(v[:n]) for f, v in enumerate(x)]


def _read(batches, d: int, ordered: bool = True) -> tuple[list, np.ndarray, int]:
    """(features, label, training rows) of the task, training rows first, sorted by all columns (``ordered``)."""
    parts = [[] for _ in range(d + 2)]
    for b in batches:
        for i in range(d + 2):
            c = b.column(i)
            if c.null_count:
                raise ValueError("features and labels of a fit must not be null")
            parts[i].append(c.to_numpy(zero_copy_only=False))
    columns = []
    while parts:  # column by column: no more than one is held twice
        p = parts.pop(0)
        columns.append(np.concatenate(p) if p else np.zeros(0))
        del p
    if any(np.isnan(c).any() for c in columns[:-1]):
        raise ValueError("features and labels of a fit must not be NaN")
    order = np.lexsort(columns if ordered else columns[-1:])
    for i in range(d + 2):
        columns[i] = columns[i][order]
    return columns[:d], columns[d], int((~columns[-1].astype(bool)).sum())


def _pieces(batches, least: int):
    """The batches in lists of ``least`` rows or a little more; the last one may be shorter."""
    some, n = [], 0
    for b in batches:
        some.append(b)
        n += b.num_rows
        if n >= least:
            yield some
            some, n = [], 0
    if some:
        yield some


def _boost(crew, splits: list, spec: dict) -> tuple[list, list]:
    """(trees, mean squared validation error after each): boosting by pseudo-residuals, the first tree on the label."""
    nominal, sizes = np.array([bool(a) for a in spec["arity"]]), np.array([len(s) + 1 for s in splits])
    trees, errors, best, since, hist = [], [], math.inf, 0, None
    for t in range(spec["n_trees"]):
        tree = _grow(crew, t, sizes, nominal, spec, hist)
        trees.append(_packed(tree, splits, nominal, spec["arity"]))
        scale = 1.0 if t == 0 else spec["step"]
        crew.then(lambda b, tree=tree, scale=scale: b.advance(tree, scale))
        if spec["held"]:
            (squares, held), hist = crew.ask(lambda b, t=t: _Pair(b.held_error(), b.histograms(t + 1, None, [], spec)))
            errors.append(float(squares / held) if held else math.nan)
            best, since = (errors[-1], 0) if errors[-1] < best else (best, since + 1)
            if since >= spec["patience"]:
                break
    return trees, errors


def _forest(crew, splits: list | None, spec: dict) -> tuple[list, list]:
    """Independent trees: on rows drawn with replacement (``bootstrap``) or on all, at common split points or at each one's own (``cuts``)."""
    nominal = np.array([bool(a) for a in spec["arity"]])
    trees = []
    for k, t in enumerate(spec["numbers"]):
        if spec["cuts"] is not None:
            splits = [np.array(c) for c in spec["cuts"][k]]

            def cut(b, splits=splits):
                own = copy.copy(b)
                own.cut(splits)
                own.x = None  # only the first blocks keep the values
                return own

            crew.afresh(cut)
        tree = _grow(crew, t, np.array([len(s) + 1 for s in splits]), nominal, spec)
        trees.append(_packed(tree, splits, nominal, spec["arity"]))
    return trees, []


# --- what a caller sees ---------------------------------------------------------------------------------

def slots(spark) -> int:
    """Tasks that can run at the same time."""
    sc = spark.sparkContext
    jvm = sc._jsc.sc()
    return max(1, min(sc.defaultParallelism, jvm.maxNumConcurrentTasks(jvm.resourceProfileManager().defaultResourceProfile())))


def share_out(n: int, fits: int, places: int) -> tuple[int, int]:
    """(blocks of a fit on n rows, fits at a time): one block if it holds them, else all cores a job, or fewer if many fits share them; a few fits side by
    side then, as half of a level's job is waiting."""
    if n <= ROWS_PER_TASK:
        return 1, places
    blocks = max(-(-n // ROWS_PER_TASK), places // max(1, fits))
    return blocks if blocks <= places else -(-blocks // places) * places, AT_A_TIME


def _spec(df: DataFrame, features: list, held: bool, given: dict) -> dict:
    spec = dict(loss="squared", n_trees=20, depth=5, step=0.1, subsample=1.0, max_bins=32, min_rows=1, min_gain=0.0, share="all", seed=0, patience=math.inf,
                cuts=None, bootstrap=False, numbers=())
    return {**spec, **given, "arity": _arities(df, features), "held": held}


def _grower(spec: dict):
    return _forest if spec["loss"] == "forest" else _boost


def grow_trees(train: DataFrame, valid: DataFrame | None, features, label: str, tasks: int, **given) -> tuple[list, list]:
    """(trees, validation errors) by ``given``: loss (squared, logistic or forest) and its parameters."""
    features = list(features)
    spec = _spec(train, features, valid is not None, given)
    d, keep, grow = len(features), spec["cuts"] is not None, _grower(spec)

    def rows(df, held):
        return df.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), F.lit(held).alias("held"))

    both = rows(train, False) if valid is None else rows(train, False).unionAll(rows(valid, True))

    def alone(batches):
        x, y, n = _read(batches, d)
        splits = None if keep else _splits([_told(x, n, spec)], spec)
        yield _record(grow(_Alone(_Block(x, y, n, 0, splits, spec)), splits, spec))

    if tasks == 1:
        return pickle.loads(both.coalesce(1).mapInArrow(alone, "data binary").collect()[0].data)
    if not keep:
        both = both.withColumns({"train": ~F.col("held")})
        return _grow_blocks(both, [(list(range(d)), d, "train", "held" if valid is not None else None, spec)], d + 1, tasks)[0]

    def block(batches):
        yield _record(_Block(*_read(batches, d), TaskContext.get().partitionId(), None, spec))

    crew = _Spread(both.repartition(tasks).mapInArrow(block, "data binary").rdd.map(lambda r: pickle.loads(r.data)))
    try:
        return grow(crew, None, spec)
    finally:
        crew.close()


def grow_together(frame: DataFrame, wanted: list[tuple], tasks: int) -> list[tuple[list, list]]:
    """What ``grow_trees`` gives for each of the wanted (rows, valid, features, label, given), grown side by side from one reading of the frame;
    rows and valid (may be None) are predicates."""
    columns = sorted({c for _, _, features, label, _ in wanted for c in (*features, label)})
    place = {c: i for i, c in enumerate(columns)}
    predicates = sorted({p for rows, valid, *_ in wanted for p in (rows, valid) if p is not None})
    flag = {p: f"p{i}" for i, p in enumerate(predicates)}
    df = frame.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *[F.coalesce(F.expr(p).cast("boolean"), F.lit(False)).alias(flag[p]) for p in predicates])
    df = df.where(functools.reduce(lambda a, b: a | b, [F.col(c) for c in flag.values()]))
    fits = [([place[f] for f in features], place[label], flag[rows], flag.get(valid), _spec(frame, list(features), valid is not None, given))
            for rows, valid, features, label, given in wanted]
    return _grow_blocks(df, fits, len(columns), tasks)


def _columns(batches, names: list[str], k: int) -> dict:
    """The columns as arrays: k of numbers (null: NaN), flags after them."""
    batches = list(batches)
    out = {}
    for i, name in enumerate(names):
        parts = [b.column(i).to_numpy(zero_copy_only=False) for b in batches]
        out[name] = np.concatenate(parts) if parts else np.zeros(0, float if i < k else bool)
    return out


def _grow_blocks(df: DataFrame, fits: list[tuple], k: int, tasks: int) -> list[tuple[list, list]]:
    """The fits (places of the features' and the label's columns, names of the flags of training and of validation rows, spec) on the
    blocks of df, which has k columns of numbers and then the flags."""
    names = df.columns

    def tell(batches, wanted=sorted({(flag, f) for features, _, flag, _, spec in fits for f, levels in zip(features, spec["arity"], strict=True) if not levels}), flags=sorted({f[2] for f in fits})):
        for some in _pieces(batches, ROWS_PER_TASK):
            x = _columns(some, names, k)
            yield _record(({flag: int(x[flag].sum()) for flag in flags}, {(flag, f): summary(_known(x[names[f]][x[flag]])) for flag, f in wanted}))

    # the summaries need no blocks: they are taken where the rows are read
    told = [pickle.loads(r.data) for r in df.coalesce(tasks).mapInArrow(tell, "data binary").collect()]
    splits = [_splits([(n[flag], [each.get((flag, f)) for f in features]) for n, each in told if n[flag]], spec) for features, _, flag, _, spec in fits]
    del told

    def build(batches):
        x = _columns(batches, names, k)
        for j, (features, label, flag, held, spec) in enumerate(fits):
            some = np.flatnonzero(x[flag])
            n = len(some)
            if held is not None:
                some = np.concatenate([some, np.flatnonzero(x[held])])
            mine = [_known(x[names[c]][some]) for c in (*features, label)]
            order = np.lexsort([*mine, np.arange(len(some)) >= n])
            mine = [v[order] for v in mine]
            yield j, _Block(mine[:-1], mine[-1], n, TaskContext.get().partitionId(), splits[j], spec)

    together = _Together(df, tasks, build, len(fits))
    return together.run(lambda j, crew: _grower(fits[j][4])(crew, splits[j], fits[j][4]))


def _known(values: np.ndarray) -> np.ndarray:
    if np.isnan(values).any():
        raise ValueError("features and labels of a fit must not be null or NaN")
    return values


def _record(value) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"data": [pickle.dumps(value, 5)]}, schema=pa.schema([("data", pa.binary())]))


def _arities(df: DataFrame, features: list[str]) -> list[int]:
    """Levels of nominal columns (their ML attributes tell), 0 for numbers."""
    out = []
    for f in features:
        attr = df.schema[f].metadata.get("ml_attr", {})
        out.append(len(attr["vals"]) if attr.get("type") == "nominal" and "vals" in attr else int(attr.get("num_vals", 0)) if attr.get("type") == "nominal" else 0)
    return out


def as_model(spark, cls, trees: list, weights: list[float], n_features: int, params: dict, **more):
    """An MLlib tree ensemble of these trees, by way of the format that MLlib saves."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/demandflow-trees/{uuid.uuid4().hex}"
    name = cls.__name__

    def meta(java, uid, values):
        return {"class": java, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid, "paramMap": values, "defaultParamMap": {}}

    nodes = [(t, (i, value, -1.0, [weight, value * weight, math.nan], round(weight), gain, left, right, (f, points, levels)))
             for t, tree in enumerate(trees) for i, (value, weight, gain, left, right, f, points, levels) in enumerate(tree)]
    spark.createDataFrame(nodes, _NODES, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
    each = [(t, json.dumps(meta("org.apache.spark.ml.regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", {"impurity": "variance"})), float(w)) for t, w in enumerate(weights)]
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    own = {**meta(f"org.apache.spark.ml.{cls.__module__.split('.')[-1]}.{name}", f"{name}_{uuid.uuid4().hex[:12]}", {"impurity": "variance", **params}),
           "numFeatures": n_features, "numTrees": len(trees), **more}
    spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    out = cls.load(path)
    out.ensemble = Ensemble(trees, [1.0 / len(trees)] * len(trees) if cls is RandomForestRegressionModel else weights, n_features)
    return out
