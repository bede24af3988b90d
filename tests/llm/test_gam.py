"""The additive quality model: features against plain Python, trees against brute force, held-out accuracy."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandflow.llm import gam
from tests.llm.conftest import edge_texts


def plain_features(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    share = lambda a, b: a / b if b else 0.0
    n, size = len(words), len(raw)
    c = Counter(raw)
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    count = {k: sum(c[b] for b in v) for k, v in gam.CLASSES.items()}
    out = {"log_bytes": math.log1p(size), "log_words": math.log1p(n), "word_bytes": share(sum(map(len, words)), n), "long_word": math.log1p(max(map(len, words), default=0))}
    out |= {f"{k}_share": share(v, size) for k, v in count.items()}
    letters = set(gam.CLASSES["upper"]) | set(gam.CLASSES["lower"]) | set(gam.CLASSES["high"])
    out |= {"upper_of_letters": share(count["upper"], count["upper"] + count["lower"]), "entropy": -sum(v / size * math.log2(v / size) for v in c.values()),
            "distinct_words": share(len(set(words)), n), "top_word": share(max(Counter(words).values(), default=0), n),
            "equal_neighbours": share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
            "repeated_trigrams": share(sum(v for v in tri.values() if v > 1), max(n - 2, 0)),
            "bare_words": share(sum(not letters & set(w) for w in words), n), "single_byte_words": share(sum(len(w) == 1 for w in words), n),
            "capital_starts": share(sum(0x41 <= w[0] <= 0x5A for w in words), n), "log_lines": math.log1p(len(lines)), "line_words": share(n, len(lines)),
            "repeated_lines": share(len(lines) - len(set(lines)), len(lines)), "stops_per_word": share(count["stop"], n), "bytes_used": len(c)}
    return [out[f] for f in gam.FEATURES]


def test_features():
    texts = [*edge_texts(), None, "a a a b", "one\n\none\ntwo", "A|B || C", "x" * 200_000]
    got = gam.features(pa.array(texts))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-9)
    assert gam.features(pa.array([], pa.string())).shape == (0, len(gam.FEATURES))


def test_cut_is_the_best():
    r = np.random.default_rng(2)
    for _ in range(50):
        g, h = r.normal(size=9) * 20, r.random(9) * 30
        gain, k = gam.best_cut(g, h)
        every = {}
        for i in range(1, 9):
            a, b, c, d = g[:i].sum(), h[:i].sum(), g[i:].sum(), h[i:].sum()
            if b >= gam.LEAST and d >= gam.LEAST:
                every[i] = a * a / (b + gam.PULL) + c * c / (d + gam.PULL) - g.sum() ** 2 / (h.sum() + gam.PULL)
        best = max(every.values(), default=0)
        assert gain == pytest.approx(max(best, 0), abs=1e-9) and (best <= 0 or every[k] == pytest.approx(best))


def test_shallow_tree_has_at_most_four_leaves():
    r = np.random.default_rng(3)
    g, h = r.normal(size=(8, 8)) * 9, r.random((8, 8)) * 30
    t = gam.shallow_tree(g, h)
    assert t.shape == g.shape and 2 <= len(np.unique(t)) <= 4
    for v in np.unique(t):
        assert v == pytest.approx(-g[t == v].sum() / (h[t == v].sum() + gam.PULL))


def test_interactions_are_learned():
    """A label that only the pair of two features tells: tables alone see nothing, the grid of the pair does."""
    r = np.random.default_rng(4)
    x = r.random((4000, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    alone, both = gam.fit(x, y, n_pairs=0), gam.fit(x, y, n_pairs=2)
    assert both.pairs[0][:2] == (1, 3)
    assert ((alone.score(x) > 0.5) == y).mean() < 0.65 and ((both.score(x) > 0.5) == y).mean() > 0.97
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(both.edges)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(both.coarse)]
    total = both.bias + sum(t[b] for t, b in zip(both.tables, bins, strict=True)) + sum(g[rough[a], rough[b]] for a, b, g in both.pairs)
    assert np.allclose(both.margin(x), total)


def test_best_round_is_kept():
    """The tables are those of the round with the least held-back loss, found by running every round."""
    r = np.random.default_rng(5)
    x, y = r.random((300, 3)), (r.random(300) < 0.5).astype(float)
    use = np.arange(300) % 5 != 0
    cells = [(x[:, f] * 6).astype(int) for f in range(3)]
    start = [np.zeros(6) for _ in cells]
    zero = np.zeros(300)
    losses = [gam.log_loss(y[~use], zero[~use])]
    for n in range(1, 16):
        tables, margin, _ = gam.boost(start, cells, y, zero, np.ones(300, bool) & use, n, 0.3, 10**9)
        if n == 15:
            best_margin = margin
    tables, margin, at = gam.boost(start, cells, y, zero, use, 15, 0.3, 10**9)
    assert gam.log_loss(y[~use], margin[~use]) <= losses[0] and 0 <= at <= 15
    assert np.allclose(margin, best_margin) and np.allclose(margin, sum(t[c] for t, c in zip(tables, cells, strict=True)))


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = gam.op12_quality(spark, d)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet").where("quality is not null"), "doc_id").select("held_out", "score", "predicted", "quality").collect()
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    rank = np.argsort(np.argsort(good + bad))[:len(good)]
    assert (rank.sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad)) > 0.98
    assert np.mean([s >= 0.7 for s in good]) > 0.97 and np.mean([s < 0.7 for s in bad]) > 0.9


def test_training_rows_are_bounded_and_fixed(spark, edge_dir):
    docs, labels = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "labels"))
    x, y = gam.training_rows(docs, labels)
    want = [r for r in labels.where("quality is not null and doc_id is not null").join(docs, "doc_id").collect()]
    assert len(x) == len(want) and y.sum() == sum(r.quality > 0 for r in want)
    again, _ = gam.training_rows(docs.repartition(7), labels.repartition(3))
    assert (again == x).all()
    assert len(gam.training_rows(docs, labels, rows=10)[0]) <= 10


def test_nothing_to_learn(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([(5, 1), (5, None), (None, 0)], "doc_id long, quality int")
    model = gam.fit(*gam.training_rows(odd_docs, labels))
    rows = gam.classify(odd_docs.withColumn("predicted", F.lit("mine")), model).collect()
    assert len(rows) == 10 and len({r.score for r in rows}) == 1  # one class: the constant alone
    none = gam.fit(*gam.training_rows(no_docs, labels.limit(0)))
    assert none.score(np.zeros((1, len(gam.FEATURES))))[0] == 0.5
    assert gam.classify(no_docs, none).collect() == []
