"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Counting: each partition adds up its documents' n-gram counts in numpy (language x bucket) and emits them once; Spark
sums the partitions' counts.  The model, a log-probability matrix of BUCKETS x languages, is of fixed size and is
broadcast; scoring gathers its rows by the n-gram buckets of a batch and sums them per document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import batches_of, frame, mix, schema_with, table

BITS = 15
BUCKETS = 1 << BITS
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: Bound on the languages of a model (its matrix is broadcast): more are an error
MAX_LANGUAGES = 256
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
PIECE_BYTES = 1 << 20
ASCII_LETTER = re.compile("[A-Za-z]")
#: ASCII characters other than letters count as spaces
FOLDED = np.array([c if chr(c).isalpha() else 0x20 for c in range(128)], np.uint64)


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter (Unicode's letters: no numbers such as ½ or Ⅷ)."""
    return ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams that start at each character, one array per size (-1 where the text ends
    before), and where each text's characters begin."""
    low = [t.lower() for t in texts]
    first = np.r_[0, np.cumsum([len(t) for t in low])].astype(np.int64)
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ascii_ = c < 128
    c[ascii_] = FOLDED[c[ascii_].astype(np.int64)]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(c))
    out, h = [], np.zeros(len(c), np.uint64)
    for k in range(1, max(SIZES) + 1):
        nxt = np.zeros(len(c), np.uint64)
        nxt[:len(c) - k + 1] = c[k - 1:]
        h = mix(h + nxt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        if k in SIZES:
            b = (h >> np.uint64(64 - BITS)).astype(np.int64)
            b[left < k] = -1
            out.append(b)
    return out, first


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-gram counts of docs (text, lang) per language, and at bucket -1 the documents."""
    def go(it):
        total: dict[str, np.ndarray] = {}
        for b in batches_of(PIECE_BYTES)(it):
            texts, langs = frame(b, "text").to_pylist(), np.array(frame(b, "lang").to_pylist(), object)
            buckets, first = grams(texts)
            names, which = np.unique(langs.astype(str), return_inverse=True)
            doc = np.repeat(which, np.diff(first)) * (BUCKETS + 1)
            counts = np.bincount(which * (BUCKETS + 1) + BUCKETS, minlength=len(names) * (BUCKETS + 1))
            for g in buckets:
                at = g >= 0
                counts = counts + np.bincount((g + doc)[at], minlength=len(names) * (BUCKETS + 1))
            for name, row in zip(names.tolist(), counts.reshape(len(names), -1), strict=True):
                total[name] = total[name] + row if name in total else row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)),
                                              pa.array(row[at].astype(np.int64))], names=["lang", "bucket", "n"])

    return (docs.select("text", "lang").mapInArrow(go, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probability matrix BUCKETS x languages) from docs (text, lang)."""
    counts = count_grams(docs.where("text is not null and lang is not null"))
    per = counts.where("bucket = -1").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    langs = [r.lang for r in per]
    prior = np.log(np.array([r.n for r in per], float)) - np.log(sum(r.n for r in per) or 1)
    n = np.full((BUCKETS, len(langs)), SMOOTHING)
    at = {x: i for i, x in enumerate(langs)}
    for r in counts.where("bucket >= 0").toLocalIterator():  # at most BUCKETS x languages
        n[r.bucket, at[r.lang]] += r.n
    return langs, prior, np.log(n) - np.log(n.sum(axis=0))


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """docs plus lang_pred and score (the posterior probability of lang_pred).

    docs: text and any other columns, kept; columns with the new names are replaced.  Null texts, texts without letters,
    and all texts where nothing was learned: 'und' with score 0.  Ties: the first language by name.
    """
    docs = docs.drop("lang_pred", "score")
    known = docs.sparkSession.sparkContext.broadcast((model[0], model[1], model[2].astype(np.float32)))
    schema = schema_with(docs, "lang_pred string, score double")

    def go(it):
        langs, prior, logp = known.value
        logp = np.vstack([logp, np.zeros((1, logp.shape[1]), np.float32)])  # -1: no n-gram
        for b in batches_of(PIECE_BYTES)(it):
            texts = frame(b, "text").fill_null("").to_pylist()
            letters = np.array([has_letter(t) for t in texts], bool)
            names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if langs and letters.any():
                some = np.flatnonzero(letters)
                buckets, first = grams([texts[i] for i in some.tolist()])
                each = sum(logp[g] for g in buckets).astype(np.float64)
                total = np.add.reduceat(each, first[:-1], axis=0) + prior
                top = total.argmax(axis=1)
                names[some] = [langs[i] for i in top.tolist()]
                scores[some] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names.tolist(), pa.string()), pa.array(scores)],
                                             names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(go, schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from all labelled documents outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(fold == HELD_OUT, F.lit(True)).alias("held_out"))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_langid": op2_langid}
ORACLE: dict = {}
