"""Operator 1: stupid-backoff scores from n-gram counts of the whole corpus.

Documents are written once as blocks of about ``BLOCK_BYTES`` of text.  Each block is exploded to its n-grams of
every order, reduced to distinct (hash, count) entries and dealt by hash to the count table's partitions.  A
partition adds up the entries of all blocks and joins the sums back to each block's entries, which return
to their block; there every n-gram is scored and scores are summed per document.  Entries travel packed, many
to a row: a row holds what one block has in one hash partition, sorted by hash.

A document's own n-grams are left out of the counts it is scored with, so that no document predicts itself.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import PLAIN, Words, batches_of, frame, gram_hashes, scratch_path, table

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 4 << 20
#: Bytes of text that are hashed at once
HASH_BYTES = 256 << 10
#: n-grams (with repeats) that one partition of the count table may gather
GRAMS_PER_PARTITION = 4_000_000
#: Bits of a hash that count, beyond those that the partition's number stands for (63 in all at most)
KEY_BITS = 48


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, n_words, payload): doc_id and text of the block's documents, compressed.

    Written as a table bucketed by block, so that what comes back to the blocks is all that is shuffled then.
    """
    spark = docs.sparkSession
    def go(it):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches_of(block_bytes)(it):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=options) as out:
                out.write_batch(b)
            n = int(Words(frame(b, "text"), PLAIN, fold=True).n_words.sum())
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([n], pa.int64()),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_words", "payload"])

    name = f"lm_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select("doc_id", "text").mapInArrow(go, "block long, n_words long, payload binary")
     .write.bucketBy(buckets, "block").option("path", scratch_path(spark, name)).saveAsTable(name))
    return spark.table(name)


def unpack(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as r:
        return r.read_next_batch()


class Grams:
    """n-grams of a block: distinct are their sorted hashes, counts how often each stands; entry[k] has the place in
    distinct of the n-gram of order k + 1 that ends at each word, -1 where its text begins later."""

    def __init__(self, texts: pa.Array, order: int, bits: int):
        hashes, sizes = [], []
        for piece in batches_of(HASH_BYTES)([pa.RecordBatch.from_arrays([texts], names=["text"])]):  # few bytes at a time
            w = Words(piece.column(0), PLAIN, fold=True)
            hashes.append(w.hashes())
            sizes.append(w.n_words)
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.n_words = np.concatenate([np.zeros(0, np.int64), *sizes])
        self.doc = np.repeat(np.arange(len(self.n_words), dtype=np.int32), self.n_words)
        place = np.arange(len(h)) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        keys = []
        for k in range(1, order + 1):
            out = np.zeros(len(h), np.uint64)
            if len(h) >= k:
                g = gram_hashes(h, k, seed=k)
                out[k - 1:] = g
            keep = place >= k - 1
            out = out >> np.uint64(64 - bits)
            keys.append((out, keep))
        self.distinct, inverse, self.counts = np.unique(
            np.concatenate([g[keep] for g, keep in keys]) if len(h) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        self.entry, at = [], 0
        for _, keep in keys:
            e = np.full(len(h), -1, np.int32)
            n = int(keep.sum())
            e[keep] = inverse[at:at + n]
            at += n
            self.entry.append(e)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, each in as many bytes as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(body), 8), np.uint8)
    out[:, :width] = body
    return np.cumsum(out.view("<u8")[:, 0], dtype=np.uint64)


def key_bits(part_bits: int) -> int:
    return min(63, part_bits + KEY_BITS)


def entries(blocked: DataFrame, order: int, part_bits: int) -> DataFrame:
    """(part, block, keys, counts): a block's distinct n-grams in one partition of the hash space."""
    bits = key_bits(part_bits)
    low = np.uint64(bits - part_bits)

    def go(it):
        for b in it:
            for block, payload in zip(frame(b, "block").to_pylist(), frame(b, "payload").to_pylist(), strict=True):
                g = Grams(unpack(payload).column(1), order, bits)
                part = (g.distinct >> low).astype(np.int64)
                cuts = np.searchsorted(part, np.arange((1 << part_bits) + 1))
                full = np.flatnonzero(np.diff(cuts)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()),
                     pa.array([pack(g.distinct[cuts[p]:cuts[p + 1]] & ((np.uint64(1) << low) - np.uint64(1))) for p in full], pa.binary()),
                     pa.array([planes(g.counts[cuts[p]:cuts[p + 1]]) for p in full], pa.binary())],
                    names=["part", "block", "keys", "counts"])

    return blocked.select("block", "payload").mapInArrow(go, "part int, block long, keys binary, counts binary")


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte: how many bytes the largest has, all lowest bytes, all second ones, and so on."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :raw[0]] = body.T
    return out.view("<u8")[:, 0]


def elsewhere(found: DataFrame) -> DataFrame:
    """(block, part, others): what the other blocks count of each entry, in the entries' order."""
    def add(_, tab):
        raw, counts = tab["keys"].to_pylist(), [unplanes(c) for c in tab["counts"].to_pylist()]
        keys = np.concatenate([unpack_keys(x) for x in raw])
        _, inverse = np.unique(keys, return_inverse=True)
        own = np.concatenate(counts)
        others = np.bincount(inverse, own).astype(np.uint64)[inverse] - own
        ends = np.cumsum([len(c) for c in counts])[:-1]
        return pa.table({"block": tab["block"], "part": tab["part"], "others": pa.array([planes(t) for t in np.split(others, ends)], pa.binary())})

    return found.groupBy("part").applyInArrow(add, "block long, part int, others binary")


def backoff_scores(g: Grams, total: np.ndarray, n_corpus: int, backoff: float) -> np.ndarray:
    """ln S of each word of a block, its own document's n-grams left out."""
    m = len(g.doc)
    others = []
    for e in g.entry:
        at = np.flatnonzero(e >= 0)
        pair = g.doc[at] * np.int64(len(total) + 1) + e[at]
        _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
        c = np.zeros(m, np.float64)
        c[at] = total[e[at]] - own[inverse]
        others.append(c)
    left = n_corpus - g.n_words[g.doc].astype(np.float64) if m else np.zeros(0)
    uni = others[0]
    score = np.log(np.where(uni > 0, uni / np.maximum(left, 1), 1 / (left + 1)))
    for k in range(1, len(others)):
        context = np.zeros(m)
        context[1:] = others[k - 1][:-1]
        has = g.entry[k] >= 0
        seen = has & (others[k] > 0) & (context > 0)
        higher = np.log(np.where(seen, others[k], 1) / np.where(seen, context, 1))
        score = np.where(seen, higher, np.where(has, score + math.log(backoff), score))
    return score


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES,
                    grams_per_partition: int = GRAMS_PER_PARTITION) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every row of docs (doc_id, text; other columns are not read).

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z lower-cased.  The score of a word is c(n-gram) / c(context)
    for the longest n-gram up to ``order`` that other documents hold, times ``backoff`` for each order skipped;
    a word that no other document holds counts as 1 / (their words + 1).  log_score sums the logarithms.
    Null and empty texts: no words, log_score 0, mean null.  Rows are documents, equal ones too (they predict one
    another).  No rows: no rows.
    """
    blocked = blocks(docs, block_bytes)
    n_corpus = int(blocked.agg(F.sum("n_words")).first()[0] or 0)
    part_bits = max(1, math.ceil(math.log2(max(2, order * n_corpus / grams_per_partition))))
    bits = key_bits(part_bits)
    back = elsewhere(entries(blocked, order, part_bits))
    kind = dict(docs.dtypes)["doc_id"]

    def score(_, left, right):
        out = []
        by_part = sorted(zip(right["part"].to_pylist(), right["others"].to_pylist(), strict=True))
        others = np.concatenate([unplanes(t) for _, t in by_part] or [np.zeros(0, np.uint64)])
        for payload in left["payload"].to_pylist():
            b = unpack(payload)
            g = Grams(b.column(1), order, bits)
            s = backoff_scores(g, (others + g.counts.astype(np.uint64)).astype(np.float64), n_corpus, backoff)
            n = g.n_words
            log = np.bincount(g.doc, s, minlength=len(n)) if len(s) else np.zeros(len(n))
            out.append(pa.table({"doc_id": b.column(0), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(log),
                                 "mean_log_score": pa.array(log / np.maximum(n, 1), mask=n == 0)}))
        return pa.concat_tables(out)

    return (blocked.select("block", "payload").groupBy("block").cogroup(back.groupBy("block"))
            .applyInArrow(score, f"doc_id {kind}, n_words long, log_score double, mean_log_score double"))


def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the trigram counts of all others."""
    s = score_documents(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))


OP1_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d),
g AS (SELECT rid, i, w, lag(w, 1) OVER p AS v, lag(w, 2) OVER p AS u, count(*) OVER (PARTITION BY rid) AS own, count(*) OVER () AS n
      FROM t WINDOW p AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY rid, w) AS c1,
             count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY rid, v, w) AS c2,
             count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY rid, u, v, w) AS c3 FROM g),
s AS (SELECT *, lag(c1) OVER p AS x1, lag(c2) OVER p AS x2 FROM c WINDOW p AS (PARTITION BY rid ORDER BY i)),
l AS (SELECT rid, CASE WHEN i >= 3 AND c3 > 0 THEN ln(c3 / x2)
                       WHEN i >= 2 AND c2 > 0 THEN ln(c2 / x1) + CASE WHEN i >= 3 THEN ln({BACKOFF}) ELSE 0 END
                       ELSE ln(CASE WHEN c1 > 0 THEN c1 / (n - own) ELSE 1 / (n - own + 1) END) + least(i - 1, 2) * ln({BACKOFF}) END AS v FROM s),
r AS (SELECT rid, sum(v) AS v FROM l GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, round(coalesce(r.v, 0), 3) AS log_score FROM d LEFT JOIN r USING (rid)"""

QUERIES = {"op1_backoff": op1_backoff}
ORACLE = {"op1_backoff": OP1_SQL}
