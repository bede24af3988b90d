"""Operator 6: substring dedup by relative Lempel-Ziv parsing.

A window is ``WINDOW`` consecutive words.  Every window has an anchor: the leftmost smallest hash among its ``SEED``-word
runs.  Equal windows have equal anchors, so only windows whose anchor stands twice or more in the corpus can repeat.
Their stretches of text (an anchor's windows) are routed by anchor hash to reference blocks.  A block indexes all its
stretches in one suffix array and parses each greedily: the longest match elsewhere is the next factor.  A
factor of a whole window or more is a duplicate span; a window that no single factor holds crosses a factor
boundary, and those are checked around each boundary.

An anchor that stands more often than ``HOT`` is dealt out to several blocks; what is left alone in its block is
then compared with the other blocks' windows by hash, one row for each distinct window of a block.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import PLAIN, Words, batches_of, frame, gram_hashes, inside, mix, row_key, save, schema_with, scratch_path, table, text_bytes

WINDOW, SEED = 35, 8
HOT = 2000
#: Words that one reference block should hold
BLOCK_WORDS = 1_000_000
PIECE_BYTES = 1 << 20
#: Text that one bucket of the written documents should hold
BUCKET_BYTES = 64 << 20


def anchors(w: Words, h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of every anchor of a batch; places are words of the batch."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none.astype(np.uint64), none, none, none
    low = gram_hashes(h, seed)
    at = np.arange(len(low))
    width, need = 1, window - seed + 1
    while width < need:
        step = min(width, need - width)
        left, right = low[:-step], low[step:]
        pick = left <= right
        low, at = np.where(pick, left, right), np.where(pick, at[:-step], at[step:])
        width += step
    ok = inside(w.first, w.n_words, window)[:len(low)]
    start = np.flatnonzero(ok)
    low, at, doc = low[start], at[start], w.doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return low[begin], at[begin], start[begin], start[np.r_[begin[1:], len(start)] - 1] if len(start) else none


def seeds(keyed: DataFrame, window: int, seed: int) -> DataFrame:
    """(seed, _k1, pos): the anchors of every text."""
    def go(it):
        for b in batches_of(PIECE_BYTES)(it):
            w = Words(frame(b, "text"), PLAIN, fold=False)
            low, at, first, _ = anchors(w, w.hashes(), window, seed)
            doc = pa.array(w.doc[first])
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), frame(b, "_k1").take(doc),
                                              pa.array((at - w.first[w.doc[first]]).astype(np.int32))], names=["seed", "_k1", "pos"])

    return keyed.select("_k1", "text").mapInArrow(go, "seed long, _k1 long, pos int")


def parse(ids: np.ndarray, first: np.ndarray, size: np.ndarray, n_windows: np.ndarray, window: int) -> np.ndarray:
    """Which places of a block start a window that stands elsewhere in the block.

    ids: the words of all stretches, each ended by an id of its own; first, size, n_windows: of each stretch.
    """
    n = len(ids)
    # suffix array of the first 64 words by prefix doubling; ranks[j] orders the first 2^j words
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    depth = max(1, math.ceil(math.log2(2 * window - SEED + 1)))
    for j in range(depth):
        nxt = np.full(n, -1, np.int64)
        nxt[:n - (1 << j)] = ranks[-1][1 << j:] if n > (1 << j) else nxt[:0]
        ranks.append(np.unique(ranks[-1] * (n + 1) + nxt + 1, return_inverse=True)[1].astype(np.int64))
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for j in range(depth, -1, -1):
        x, y = a + common, b + common
        ok = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[j][x[ok]] == ranks[j][y[ok]]
        common += same << j
    longest = np.zeros(n, np.int64)  # the longest match elsewhere from each place on
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    out = np.zeros(n, bool)
    for lo, words, windows in zip(first.tolist(), size.tolist(), n_windows.tolist(), strict=True):
        i, end = lo, lo + words
        while i < end:
            step = max(1, int(longest[i]))
            if step >= window:  # a factor that holds whole windows
                out[i:i + step - window + 1] = True
            i += step
            if i < end:  # windows across the boundary
                s = max(lo, i - window + 1)
                out[s:i] |= longest[s:i] >= window
        out[lo + windows:end] = False  # the words after the last window of the stretch are context
    return out


def duplicate_windows(keyed: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, block_words: int = BLOCK_WORDS,
                      buckets: int = 0) -> DataFrame:
    """(_k1, _k2, first, last): runs of window starts that stand elsewhere, too, by row key.

    buckets: as many as keyed is bucketed by _k1 into, if it is; places are dealt likewise, so that texts stay.
    """
    found = save(seeds(keyed, window, seed), "anchors")
    often = found.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    often = save(often, "often")
    total = int(often.agg(F.sum("n")).first()[0] or 0)
    n_blocks = max(1, math.ceil(total * 1.5 * window / block_words))
    # half of the key will do here: places of a text of equal half would only be looked at in vain
    wanted = found.join(often, "seed").select("_k1", F.struct("pos", F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("parts")).alias("p"))
    wanted = (wanted.repartition(buckets, "_k1") if buckets else wanted).groupBy("_k1").agg(F.collect_set("p").alias("places"))
    texts = keyed.select("_k1", "_k2", "text").join(wanted, "_k1")

    def deal(it):
        for b in batches_of(PIECE_BYTES)(it):
            w = Words(frame(b, "text"), PLAIN, fold=False)
            h = w.hashes()
            low, at, first, last = anchors(w, h, window, seed)
            doc = w.doc[first]
            parts = np.zeros(len(h) + 1, np.int64)
            for d, places in enumerate(frame(b, "places").to_pylist()):
                base = int(w.first[d])
                for p in places:
                    parts[base + p["pos"]] = p["parts"]
            keep = np.flatnonzero(parts[at])
            at, low, first, last, doc = at[keep], low[keep], first[keep], last[keep], doc[keep]
            k1 = frame(b, "_k1").take(pa.array(doc))
            salt = mix(k1.to_numpy().view(np.uint64) + at.astype(np.uint64)) % parts[at].astype(np.uint64)
            block = mix(low + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_blocks)
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int64)), k1, frame(b, "_k2").take(pa.array(doc)),
                 pa.array((first - w.first[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)), pa.array(parts[at] > 1),
                 pa.array([raw[8 * x:8 * (y + window)] for x, y in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())],
                names=["block", "_k1", "_k2", "first", "n", "hot", "words"])

    stretches = texts.mapInArrow(deal, "block long, _k1 long, _k2 long, first int, n int, hot boolean, words binary")

    def factor(_, tab):
        raw = tab["words"].to_pylist()
        size = np.array([len(x) // 8 for x in raw], np.int64)
        lo = np.cumsum(size + 1) - (size + 1)
        hashes = np.frombuffer((b"\0" * 8).join(raw) + b"\0" * 8, np.uint64)
        ids = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
        ids[lo + size] = len(ids) + np.arange(len(size))  # a separator of its own for each stretch
        n_windows = tab["n"].to_numpy().astype(np.int64)
        dup = parse(ids, lo, size, n_windows, window)
        # runs of repeated windows
        edge = np.diff(np.r_[False, dup, False].astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        which = np.searchsorted(lo, begin, "right") - 1
        shift = tab["first"].to_numpy().astype(np.int64) - lo
        k1, k2 = tab["_k1"].to_numpy(), tab["_k2"].to_numpy()
        rows = [k1[which], k2[which], begin + shift[which], end + shift[which], np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)]
        # of stretches with hot anchors: every distinct window, to be compared with other blocks; its place only if it stood alone
        is_hot = tab["hot"].to_numpy(zero_copy_only=False)
        if is_hot.any():
            hot_at = np.concatenate([np.arange(x, x + m) for x, m in zip(lo[is_hot].tolist(), n_windows[is_hot].tolist(), strict=True)])
            own = np.searchsorted(lo, hot_at, "right") - 1
            h1, h2 = gram_hashes(hashes, window, seed=1)[hot_at], gram_hashes(hashes, window, seed=2)[hot_at]
            _, once = np.unique(np.stack([h1, h2]), axis=1, return_index=True)
            hot_at, own, h1, h2 = hot_at[once], own[once], h1[once], h2[once]
            start = np.where(dup[hot_at], -1, hot_at + shift[own])
            more = [k1[own], k2[own], start, start, h1.view(np.int64), h2.view(np.int64)]
            rows = [np.concatenate([x, y]) for x, y in zip(rows, more, strict=True)]
        return pa.table({c: pa.array(x) for c, x in zip(("_k1", "_k2", "first", "last", "h1", "h2"), rows, strict=True)})

    runs = save(stretches.groupBy("block").applyInArrow(factor, "_k1 long, _k2 long, first long, last long, h1 long, h2 long"), "runs")
    sure = runs.where("h1 = 0 and h2 = 0").select("_k1", "_k2", "first", "last")
    across = (runs.where("h1 <> 0 or h2 <> 0").groupBy("h1", "h2")
              .agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("first") >= 0, F.struct("_k1", "_k2", "first", "last"))).alias("alone"))
              .where("n > 1").select(F.explode("alone").alias("x")).select("x.*"))
    return sure.unionByName(across)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hot: int = HOT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs plus kept_text, n_words and n_removed (longs).

    docs: doc_id, text and any other columns, kept; columns with the new names are replaced.  Words are runs of anything
    but ``[\\x20\\x09-\\x0D]``, as they stand.  Every word in a window whose word sequence starts anywhere else, in the
    same text too, is removed; all windows are judged on the input.  kept_text: the words left, joined by one space.
    Null and empty texts and texts of fewer than ``window`` words lose nothing; null counts as ''.  Equal rows repeat
    one another.  No rows: no rows.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed", "_k1", "_k2", "runs")
    # texts are written once, bucketed by key, so that neither of the two joins with them moves them
    spark = docs.sparkSession
    name = f"keyed_{uuid.uuid4().hex}"
    buckets = max(8, -(-text_bytes(docs) // BUCKET_BYTES))
    (docs.withColumns(dict(zip(("_k1", "_k2"), row_key("doc_id", "text"), strict=True)))
     .write.bucketBy(buckets, "_k1").option("path", scratch_path(spark, name)).saveAsTable(name))
    keyed = spark.table(name)
    runs = (duplicate_windows(keyed, window, seed, hot, block_words, buckets).distinct()
            .groupBy("_k1", "_k2").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
            .select(F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), "runs"))
    # xor, not equality: the second half is compared, but is no join key, as the buckets are by the first
    same = (F.col("_k1") == F.col("_r1")) & (F.col("_k2").bitwiseXOR(F.col("_r2")) == 0)
    marked = keyed.join(runs, same, "left").select(*docs.columns, "runs")
    schema = schema_with(docs, "kept_text string, n_words long, n_removed long")

    def go(it):
        for b in batches_of(PIECE_BYTES)(it):
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(frame(b, "text").to_pylist(), frame(b, "runs").to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes: exactly the six ASCII spaces
                gone = 0
                if spans:
                    d = np.zeros(len(words) + 1, np.int64)
                    np.add.at(d, [s["first"] for s in spans], 1)
                    np.add.at(d, [s["last"] + window for s in spans], -1)
                    keep = np.cumsum(d[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    left = [words[i] for i in np.flatnonzero(keep).tolist()]
                else:
                    left = words
                kept.append(b" ".join(left).decode())
                n_words.append(len(words))
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                                             names=schema.names)

    return marked.mapInArrow(go, schema)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents: doc_id, n_words, n_removed, kept_sha256."""
    r = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
      FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY win) AS c FROM v) WHERE c > 1),
g AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM r),
t AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT t.rid, count(g.p) AS gone, string_agg(t.x, ' ' ORDER BY t.p) FILTER (WHERE g.p IS NULL) AS kept
      FROM t LEFT JOIN g ON g.rid = t.rid AND g.p = t.p GROUP BY t.rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""

QUERIES = {"op6_substrings": op6_substrings}
ORACLE = {"op6_substrings": OP6_SQL}
