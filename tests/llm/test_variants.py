"""Spelling variants: the composition against brute force, hot groups, odd input."""

import random

import numpy as np
import pyarrow as pa
import pytest

from demandflow.llm import variants
from tests.compare import compare
from tests.llm.conftest import SCHEMA
from tests.llm.test_sql_operators import edge_duck


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(counts, factor=10):
    """(word, form, root, n, n_near, form_n) by comparing all words with all."""
    form = {}
    rows = []
    for w, n in counts.items():
        around = sorted((-counts[x], x) for x in counts if near(w, x))
        best = around[0] if around else (0, None)
        form[w] = best[1] if around and -best[0] >= factor * n else None
        rows.append((w, form[w], n, len(around), -best[0] if form[w] else None))

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, f, root(w), n, k, m) for w, f, n, k, m in rows)


def word_tables():
    r = random.Random(11)
    some = {"".join(r.choice("ab") for _ in range(r.randrange(7, 11))): r.choice([2, 3, 30, 400]) for _ in range(150)}
    shared = {"prefix" + "".join(r.choice("abcé") for _ in range(r.randrange(1, 5))): r.choice([2, 25, 300]) for _ in range(120)}
    ends = {"".join(r.choice("abc") for _ in range(3)) + "same": r.choice([2, 25, 300]) for _ in range(27)}
    chain = {"aaaaaaa": 2, "aaaaaaab": 20, "aaaaaaabc": 200, "aaaaaaabcd": 2000, "zzzzzzz": 5, "zzzzzzzz": 50}
    long = {"x" * 5000: 2, "x" * 4999: 40, "x" * 2500 + "y" + "x" * 2499: 3, "q" * 7: 9}
    return {"some": some, "shared": shared, "ends": ends, "chain": chain, "long": long, "one": {"abcdefg": 2}, "none": {}}


@pytest.mark.parametrize("name", list(word_tables()))
@pytest.mark.parametrize("group_words,bucket_chars", [(50_000, 1_000_000), (4, 60)])
def test_variants_of_words(spark, name, group_words, bucket_chars):
    """Groups of four words at most: every narrower class of edit places is used."""
    counts = word_tables()[name]
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = variants.group_variants(words, group_words=group_words, bucket_chars=bucket_chars)
    assert sorted(map(tuple, got.collect())) == brute(counts)


def test_groups_are_bounded_and_complete(spark):
    counts = word_tables()["shared"]
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = variants.deal(words, group_words=10).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.key, []).append(r)
    for g in groups.values():
        assert len(g) <= 10 or (g[0].hi is not None and g[0].hi - g[0].lo == 1 and len(g) <= 4 + 16)  # four letters: one free place in the shorter words, two in the longer
    pairs = {frozenset((a, b)) for a in counts for b in counts if near(a, b)}
    assert pairs == {frozenset((a.word, b.word)) for g in groups.values() for a in g for b in g if near(a.word, b.word)}


def test_acceptor_is_minimal_and_numbers_its_words():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(0, 7))) for _ in range(120)})
    codes, at = variants.code_points(pa.array(words))
    a = variants.Acceptor(np.zeros(len(words), np.int64), codes, at)
    rest = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(a.final) == len(rest)
    for i, w in enumerate(words):
        q, number = int(a.starts[0]), 0
        for c in w:
            arc = a.first[q] + a.arc_label[a.first[q]:a.first[q + 1]].tolist().index(ord(c))
            q, number = int(a.arc_to[arc]), number + int(a.arc_skip[arc])
        assert a.final[q] and number == i


def test_small_groups_over_documents(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    assert not compare(variants.spelling_variants(docs, group_words=6, bucket_chars=200), edge_duck(edge_dir), variants.OP11_SQL)


def test_variants_of_odd_documents(spark, odd_docs, no_docs):
    assert variants.spelling_variants(no_docs).collect() == []
    assert variants.spelling_variants(odd_docs).collect() == []  # no word of seven code points twice
    rows = [(None, "Strasse STRASSE strasse"), (None, "Strasse STRASSE strasse"), (1, None), (2, ""), (3, "strassé " * 90 + "×" * 7), (3, "e" * 5_000 + " " + "e" * 5_000)]
    docs = spark.createDataFrame([(i, t, None, "n", 0) for i, t in rows], SCHEMA).withColumnRenamed("source", "word")
    got = {r.word: r for r in variants.spelling_variants(docs).collect()}
    assert got["strassé"].n >= 89 and got["strassé"].form is None
    assert sum(r.n for w, r in got.items() if w.startswith("eeee")) == 2
    assert all(r.root == r.word if r.form is None else r.form_n >= 10 * r.n for r in got.values())
