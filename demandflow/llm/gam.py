"""Operator 12: quality classifier, a generalised additive model with pairwise interactions.

A text is described by some thirty numbers (counts of bytes, words and lines of the whole text, no prefix).  Every number is
cut into bins; the model is a constant, one table of bin values per feature, and one grid of bin values per chosen pair of
features.  Cyclic boosting fits them: in turn each feature gets a shallow tree (two levels of splits of its bins) on the
gradients that all tables so far leave, a small share of which is added to its table; when the held-back rows stop
gaining, the pairs whose best four-cell cut explains most of what is left are boosted the same way.  A score is the
logistic function of the sum of the tables' values at the text's bins.

Spark computes the features and the scores (one narrow pass each, no shuffle of texts); the fit is numpy on a bounded sample
of labelled rows (``TRAIN_ROWS``).  The model is some tens of kilobytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import PLAIN, Words, batches_of, frame, gram_hashes, inside, schema_with, table

PIECE_BYTES = 1 << 20
#: Bound on the labelled rows that the model is fitted on (picked by a hash of their ids)
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, RATE, PATIENCE = 400, 0.1, 20
#: Second-order boosting: the weight that pulls leaves to zero, and the least weight of a leaf
PULL, LEAST = 1.0, 5.0
FOLDS, HELD_OUT = 4, 2
CUTOFF = 0.7

NOT_LINE_END = np.array([b != 0x0A for b in range(256)])
CLASSES = {
    "upper": [*range(0x41, 0x5B)], "lower": [*range(0x61, 0x7B)], "digit": [*range(0x30, 0x3A)], "space": [0x20, *range(0x09, 0x0E)],
    "mark": [ord(c) for c in "#*$%&<>"], "bar": [ord("|")], "cry": [ord("!")], "stop": [ord(c) for c in ".,;:?"],
    "high": [*range(0x80, 0x100)], "control": [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F],
}
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_word", *(f"{c}_share" for c in CLASSES), "upper_of_letters", "entropy",
    "distinct_words", "top_word", "equal_neighbours", "repeated_trigrams", "bare_words", "single_byte_words", "capital_starts",
    "log_lines", "line_words", "repeated_lines", "stops_per_word", "bytes_used",
)


# --- features of whole texts ------------------------------------------------------------------------

def runs_per_text(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, largest number of one hash, rows whose hash stands more than once) of each text."""
    distinct, most, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(h):
        order = np.lexsort((h, doc))
        d, x = doc[order], h[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
        size = np.diff(np.r_[first, len(x)])
        distinct = np.bincount(d[first], minlength=n)
        np.maximum.at(most, d[first], size)
        repeated = np.bincount(d[first], weights=np.where(size > 1, size, 0), minlength=n).astype(np.int64)
    return distinct, most, repeated


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; null counts as empty, and shares of nothing are 0."""
    w = Words(texts, PLAIN, fold=False)
    n = len(w.n_words)
    size = np.diff(w.offsets).astype(np.int64)
    text_of = np.repeat(np.arange(n), size)
    bytes_ = np.bincount(text_of * 256 + w.buf, minlength=n * 256).reshape(n, 256).astype(float)
    h = w.hashes()
    length = w.end - w.start
    share = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
    per_doc = lambda mask: np.bincount(w.doc[mask], minlength=n)
    cols = {"log_bytes": np.log1p(size), "log_words": np.log1p(w.n_words), "word_bytes": share(np.bincount(w.doc, weights=length, minlength=n), w.n_words)}
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    cols["long_word"] = np.log1p(longest)
    counts = {c: bytes_[:, members].sum(axis=1) for c, members in CLASSES.items()}
    cols |= {f"{c}_share": share(x, size) for c, x in counts.items()}
    cols["upper_of_letters"] = share(counts["upper"], counts["upper"] + counts["lower"])
    p = bytes_ / np.maximum(size, 1)[:, None]
    cols["entropy"] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    distinct, most, _ = runs_per_text(w.doc, h, n)
    cols["distinct_words"], cols["top_word"] = share(distinct, w.n_words), share(most, w.n_words)
    equal = np.zeros(len(h), bool)
    equal[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    cols["equal_neighbours"] = share(per_doc(equal), w.n_words)
    tri = gram_hashes(h, 3)
    whole = inside(w.first, w.n_words, 3)[:len(tri)]
    cols["repeated_trigrams"] = share(runs_per_text(w.doc[:len(tri)][whole], tri[whole], n)[2], np.maximum(w.n_words - 2, 0))
    letter = np.zeros(256, bool)
    letter[[*CLASSES["upper"], *CLASSES["lower"], *CLASSES["high"]]] = True
    seen = np.r_[0, np.cumsum(letter[w.buf])]
    cols["bare_words"] = share(per_doc(seen[w.end] == seen[w.start]), w.n_words)
    cols["single_byte_words"] = share(per_doc(length == 1), w.n_words)
    starts = w.buf[w.start]
    cols["capital_starts"] = share(per_doc((starts >= 0x41) & (starts <= 0x5A)), w.n_words)
    lines = Words(texts, NOT_LINE_END, fold=False)
    cols["log_lines"], cols["line_words"] = np.log1p(lines.n_words), share(w.n_words, lines.n_words)
    cols["repeated_lines"] = share(lines.n_words - runs_per_text(lines.doc, lines.hashes(), n)[0], lines.n_words)
    cols["stops_per_word"] = share(counts["stop"], w.n_words)
    cols["bytes_used"] = (bytes_ > 0).sum(axis=1).astype(float)
    return np.column_stack([cols[f] for f in FEATURES]) if n else np.zeros((0, len(FEATURES)))


def text_features(docs: DataFrame) -> DataFrame:
    """docs plus features (array<double>, in the order of FEATURES), one narrow pass."""
    docs = docs.drop("features")
    schema = schema_with(docs, "features array<double>")

    def go(it):
        for b in batches_of(PIECE_BYTES)(it):
            x = features(frame(b, "text"))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=[*b.schema.names, "features"])

    return docs.mapInArrow(go, schema)


# --- the model -------------------------------------------------------------------------------------

def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, place) of the best split of bins 0..place-1 from the others; gain 0: none."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    tg, th = g.sum(), h.sum()
    gain = cg**2 / (ch + PULL) + (tg - cg)**2 / (th - ch + PULL) - tg**2 / (th + PULL)
    gain[(ch < LEAST) | (th - ch < LEAST)] = 0
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 0 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray, levels: int = 2) -> np.ndarray:
    """Leaf value of every cell after ``levels`` levels of splits along the axes of the gradient grids g and h."""
    best = (0.0, 0, 0)
    if levels:
        for axis in range(g.ndim):
            other = tuple(a for a in range(g.ndim) if a != axis)
            gain, k = best_cut(g.sum(axis=other), h.sum(axis=other))
            if gain > best[0]:
                best = (gain, axis, k)
    if best[0] == 0:
        return np.full(g.shape, -g.sum() / (h.sum() + PULL))
    _, axis, k = best
    parts = [shallow_tree(*(np.split(x, [k], axis=axis)[side] for x in (g, h)), levels - 1) for side in (0, 1)]
    return np.concatenate(parts, axis=axis)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_loss(y: np.ndarray, margin: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margin) - y * margin))


class Model:
    """edges: inner bin edges of each feature; tables: bin values of each feature; pairs: (feature, feature, grid of values);
    coarse: inner edges of the pairs' bins."""

    def __init__(self, n_features: int):
        self.bias = 0.0
        self.edges = [np.zeros(0)] * n_features
        self.coarse = [np.zeros(0)] * n_features
        self.tables = [np.zeros(1)] * n_features
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the tables' values at the bins of each row."""
        out = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            out += t[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for a, b, grid in self.pairs:
            out += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.margin(x))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most ``bins`` bins of about equal numbers of rows."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher")) if len(x) else np.zeros(0)


def boost(tables: list[np.ndarray], cells: list[np.ndarray], y, margin, fit, rounds: int, rate: float, patience: int) -> tuple[list, np.ndarray, int]:
    """Cyclic boosting of tables whose flat cell numbers per row are ``cells``: (tables of the best round on the rows not in
    fit, all rows' margins, that round).  Without such rows the last round counts."""
    tables = [t.copy() for t in tables]
    margin = margin.copy()
    held = ~fit
    best = (log_loss(y[held], margin[held]) if held.any() else np.inf, [t.copy() for t in tables], margin.copy(), 0)
    for r in range(1, rounds + 1):
        for t, c in zip(tables, cells, strict=True):
            p = logistic(margin[fit])
            g = np.bincount(c[fit], weights=p - y[fit], minlength=t.size).reshape(t.shape)
            h = np.bincount(c[fit], weights=p * (1 - p), minlength=t.size).reshape(t.shape)
            step = rate * shallow_tree(g, h)
            t += step
            margin += step.ravel()[c]
        loss = log_loss(y[held], margin[held]) if held.any() else -r
        if loss < best[0] - 1e-6:
            best = (loss, [t.copy() for t in tables], margin.copy(), r)
        elif r - best[3] >= patience:
            break
    return best[1], best[2], best[3]


def interaction_gains(cells: list[np.ndarray], sizes: list[int], g: np.ndarray, h: np.ndarray) -> list[tuple[float, int, int]]:
    """(gain, a, b) of every pair of features, largest first: the best cut of both into four cells, by the gradients left."""
    out = []
    for a in range(len(cells)):
        for b in range(a + 1, len(cells)):
            if sizes[a] < 2 or sizes[b] < 2:
                continue
            cell = cells[a] * sizes[b] + cells[b]
            cg, ch = (np.bincount(cell, weights=v, minlength=sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]).cumsum(0).cumsum(1) for v in (g, h))
            total = np.zeros((sizes[a] - 1, sizes[b] - 1))
            for rows in ("low", "high"):
                for columns in ("low", "high"):
                    q = []
                    for c in (cg, ch):
                        low = c[:-1, :-1]
                        row, column, whole = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
                        q.append({"lowlow": low, "lowhigh": row - low, "highlow": column - low, "highhigh": whole - row - column + low}[rows + columns])
                    total += q[0]**2 / (q[1] + PULL)
            out.append((float(total.max()), a, b))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None, rounds: int = ROUNDS, rate: float = RATE, patience: int = PATIENCE,
        n_pairs: int = PAIRS) -> Model:
    """The model of rows x (features) and y (0 or 1).  held: rows that only tell when to stop (default: every fifth).

    One class only, or no rows: the constant alone, its share smoothed by one row of each class."""
    m = Model(x.shape[1])
    share = (y.sum() + 1) / (len(y) + 2)
    m.bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return m
    use = ~(np.arange(len(y)) % 5 == 0 if held is None else held)
    m.edges = [quantile_edges(x[:, f], BINS) for f in range(x.shape[1])]
    m.coarse = [quantile_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    margin = np.full(len(y), m.bias)
    cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.edges)]
    m.tables, margin, _ = boost([np.zeros(len(e) + 1) for e in m.edges], cells, y, margin, use, rounds, rate, patience)
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(m.coarse)]
    sizes = [len(e) + 1 for e in m.coarse]
    p = logistic(margin[use])
    gains = interaction_gains([c[use] for c in rough], sizes, p - y[use], p * (1 - p))[:n_pairs]
    pair_cells = [rough[a] * sizes[b] + rough[b] for _, a, b in gains]
    grids, _, _ = boost([np.zeros((sizes[a], sizes[b])) for _, a, b in gains], pair_cells, y, margin, use, rounds if gains else 0, rate, patience)
    m.pairs = [(a, b, g) for (_, a, b), g in zip(gains, grids, strict=True)]
    return m


# --- Spark -----------------------------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(features, quality) of at most ``rows`` labelled documents (some 20,000 rows of thirty numbers), in a fixed order.

    docs: doc_id, text; labels: doc_id, quality.  Labels beyond the bound are left out by a hash of their ids; labels without
    quality or id, and labels of no document, teach nothing."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("_quality"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    known = known.limit(rows)
    x = text_features(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).select("doc_id", "_quality", "features").limit(rows).collect()
    x = sorted((str(r.doc_id), r._quality, tuple(r.features)) for r in x)
    return np.array([r[2] for r in x]).reshape(len(x), len(FEATURES)), np.array([float(r[1] > 0) for r in x])


def classify(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """docs plus score (the probability of quality 1) and predicted (1 if score >= cutoff, else 0).

    docs: text and any other columns, kept; columns with the new names are replaced.  Null and empty texts are scored as texts
    without bytes.  Equal texts get equal scores.  A text of any length is read whole.  One narrow pass.
    """
    docs = docs.drop("score", "predicted")
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = schema_with(docs, "score double, predicted int")

    def go(it):
        m = known.value
        for b in batches_of(PIECE_BYTES)(it):
            s = m.score(features(frame(b, "text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= cutoff).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(go, schema)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document, learned from labels outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT)
    model = fit(*training_rows(docs, labels))
    return classify(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op12_quality": op12_quality}
ORACLE: dict = {}
