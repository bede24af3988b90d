"""Operator 10: benchmark decontamination with Wu-Manber multi-pattern search.

Patterns are the benchmark's windows, written as `` w1 w2 ... w10 `` between single spaces; documents are
brought to the same form, so that a byte match is a match of whole words.  Patterns are put into classes
of similar length.  A class has a minimum length m, a table SHIFT over hashed blocks of B bytes (how far
the search may jump when that block ends at the current place), buckets of patterns by the block that
ends their first m bytes, and the first 8 bytes of each pattern as a prefix test.  The search runs many
cursors at once, each over its own stretch of the text: where SHIFT is 0, the bucket's patterns whose prefix
agrees are compared byte by byte.

Documents are never shuffled.  The patterns are broadcast in chunks of at most about ``CHUNK_BYTES``; a larger
benchmark is searched chunk after chunk over all documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import ALNUM, Words, batches_of, covered, frame, save, table

WINDOW = 10
CHUNK_BYTES = 8 << 20
#: Chunks searched in one chain of narrow passes before the state is written
CHAIN = 4
PIECE_BYTES = 4 << 20
LANE_BYTES = 1024
_K = np.uint64(0x9E3779B97F4A7C15)


class Class:
    """Tables for patterns whose lengths lie between m and 2 m."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        self.m = m = min(map(len, patterns))
        self.block = b = min(m, 8)
        self.bits = int(np.clip(np.ceil(np.log2(len(patterns) * (m - b + 1) + 1)) + 3, 8, 20))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int64)
        head = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(len(patterns), m)
        for q in range(b, m + 1):
            np.minimum.at(self.shift, self.hash(_load(head, q - b, b)), m - q)
        at = self.hash(_load(head, m - b, b))
        order = np.argsort(at, kind="stable")
        self.first = np.searchsorted(at[order], np.arange((1 << self.bits) + 1))
        self.patterns = [patterns[i] for i in order]
        self.ids = np.array(ids)[order]
        self.prefix = _load(head, 0, b)[order]

    def hash(self, x: np.ndarray) -> np.ndarray:
        return ((x * _K) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern id) of every occurrence in buf."""
        n, m, b = len(buf), self.m, self.block
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        words = np.ndarray((n,), "<u8", padded.data, strides=(1,))  # the 8 bytes from each place on
        mask = np.uint64(2**64 - 1 if b == 8 else (1 << (8 * b)) - 1)
        lo = np.arange(m - 1, n, LANE_BYTES)
        hi = np.minimum(lo + LANE_BYTES, n)
        j, found = lo, []
        while len(j):
            s = self.shift[self.hash(words[j - b + 1] & mask)]
            stop = s == 0
            if stop.any():
                found.append(j[stop])
            j = j + np.maximum(s, 1)
            alive = j < hi
            if not alive.all():
                j, hi = j[alive], hi[alive]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.sort(np.concatenate(found)) - m + 1
        h = self.hash(words[start + m - b] & mask)
        size = self.first[h + 1] - self.first[h]
        place = np.repeat(start, size)
        which = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[h], size)
        same = (words[place] & mask) == self.prefix[which]
        place, which = place[same], which[same]
        raw = buf.tobytes()
        hit = np.fromiter((raw.startswith(self.patterns[w], p) for p, w in zip(place.tolist(), which.tolist(), strict=True)),
                          bool, len(place))
        return place[hit], self.ids[which[hit]]


def _load(rows: np.ndarray, at: int, size: int) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :size] = rows[:, at:at + size]
    return out.view("<u8")[:, 0]


def classes(patterns: list[bytes]) -> list[Class]:
    by: dict[int, list[int]] = defaultdict(list)
    for i, p in enumerate(patterns):
        by[len(p).bit_length()].append(i)
    return [Class([patterns[i] for i in ids], ids) for _, ids in sorted(by.items())]


def spaced(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch as bytes, each between single spaces, texts parted by newlines; and where each word starts."""
    size = w.end - w.start
    start = 1 + np.cumsum(size + 1) - (size + 1) + 2 * w.doc
    out = np.full(int(start[-1] + size[-1] + 2) if len(start) else 0, 0x20, np.uint8)
    if len(start):
        source = np.flatnonzero(ALNUM[w.buf])
        out[source + np.repeat(start - w.start, size)] = w.buf[source]
        last = np.flatnonzero(np.diff(np.r_[w.doc, -1]))
        out[start[last] + size[last] + 1] = 0x0A
    return out, start


def window_rows(items: DataFrame, window: int) -> DataFrame:
    """(item, pattern, n): every distinct window of every item."""
    def go(it):
        for b in batches_of(PIECE_BYTES)(it):
            w = Words(frame(b, "text"), ALNUM, fold=True)
            raw, ids = w.buf.tobytes(), frame(b, "item").to_pylist()
            rows = set()
            for i, item in enumerate(ids):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                k = min(window, hi - lo)
                for s in range(lo, hi - k + 1) if k else ():
                    rows.add((item, b" " + b" ".join(raw[w.start[x]:w.end[x]] for x in range(s, s + k)) + b" ", k))
            a = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.binary()), pa.array(a[2], pa.int32())],
                                             names=["item", "pattern", "n"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return named.mapInArrow(go, "item string, pattern binary, n int").distinct()


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs plus n_words (long), hit_words (sorted array of word places) and hit_items (array of item ids as strings).

    docs: text and any other columns, kept; columns with the new names are replaced.  items: item_id, text.
    A word is a run of digits, letters a-z (after folding A-Z) and characters beyond ASCII.  Null and empty texts have
    no words; items without words have no windows; items of fewer than ``window`` words are one
    window.  Items of one id are one item, a missing id is the id 'null'.  Equal rows get equal results.
    """
    spark = docs.sparkSession
    windows = save(window_rows(items, window), "windows")
    total = windows.agg(F.sum(F.octet_length("pattern") + F.octet_length("item") + 16)).first()[0] or 0
    n_chunks = max(1, -(-int(total) // chunk_bytes))
    out = docs.drop("n_words", "hit_words", "hit_items").withColumns({
        "n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")})
    schema = out.schema
    for c in range(n_chunks):
        part = windows.where(F.pmod(F.xxhash64("pattern", "item"), F.lit(n_chunks)) == c)
        items_of, size_of = defaultdict(list), {}
        for r in part.toLocalIterator():  # about chunk_bytes
            items_of[bytes(r.pattern)].append(r.item)
            size_of[bytes(r.pattern)] = r.n
        patterns = list(items_of)
        known = spark.sparkContext.broadcast((patterns, [size_of[p] for p in patterns], [items_of[p] for p in patterns]))
        out = out.mapInArrow(_searcher(known), schema)
        if c % CHAIN == CHAIN - 1 and c < n_chunks - 1:
            out = save(out, "searched")
    return out


def _searcher(known):
    def go(it):
        patterns, sizes, items_of = known.value
        sizes, tables = np.array(sizes, np.int64), classes(patterns)
        for b in batches_of(PIECE_BYTES)(it):
            w = Words(frame(b, "text"), ALNUM, fold=True)
            buf, start = spaced(w)
            places, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in tables:
                p, i = t.search(buf)
                places.append(p)
                ids.append(i)
            first, ids = np.searchsorted(start, np.concatenate(places) + 1), np.concatenate(ids)
            hit = covered(first, sizes[ids] if len(ids) else 0, len(start))
            where = np.flatnonzero(hit)
            words, found = frame(b, "hit_words").to_pylist(), frame(b, "hit_items").to_pylist()
            for d in np.unique(w.doc[where]).tolist():
                mine = where[(lo := np.searchsorted(where, w.first[d])):np.searchsorted(where, w.first[d + 1])] - w.first[d]
                words[d] = sorted({*words[d], *mine.tolist()})
            for d, i in sorted(set(zip(w.doc[first].tolist(), ids.tolist(), strict=True))):
                found[d] = found[d] + items_of[i]
            found = [sorted(set(x)) if x else x for x in found]
            new = {"n_words": pa.array(w.n_words, pa.int64()), "hit_words": pa.array(words, pa.list_(pa.int32())),
                   "hit_items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(f.name, b.column(k)) for k, f in enumerate(b.schema)], names=b.schema.names)
    return go


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``find`` plus n_hit, n_items (longs) and contaminated (boolean)."""
    f = find(docs.drop("n_hit", "n_items", "contaminated"), items, window, chunk_bytes)
    return f.withColumns({"n_hit": F.size("hit_words").cast("long"), "n_items": F.size("hit_items").cast("long"),
                          "contaminated": F.size("hit_words") > 0})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark windows in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    f = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return f.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP10_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i
             FROM (SELECT item, w, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, dw.i, dw.k, item FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""

QUERIES = {"op10_decontamination": op10_decontamination}
ORACLE = {"op10_decontamination": OP10_SQL}
