"""Operator 4: near-duplicate detection with min-max hashing.

Each of ``PERMS`` permutations of a document's shingle hashes gives two signature values, its minimum and its
maximum, so that 2 * PERMS values cost PERMS hash evaluations.  Values are banded; documents that share a
band are candidates.  Exact copies (equal sets) are collapsed before anything is paired.

Pairs are never emitted.  Every band bucket has a hub, its smallest member; (member, hub) are the only rows made,
so their number is linear.  Members of one bucket are members of that hub's *star*; a task gets a star's whole
shingle sets, confirms links on them and returns one row per linked member (a spanning forest).  A star of
over ``STAR_WEIGHT`` shingles is dealt out as pairs of blocks, with the hub in each.  Components of all links are
found by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import PLAIN, Words, batches_of, frame, gram_hashes, inside, mix, save, table

WORDS = 5
PERCENT = 75
PERMS, ROWS = 128, 5  # 51 bands of 5 values: a pair of similarity 0.75 is missed with probability 1e-6
STAR_WEIGHT = 4_000_000
PIECE_BYTES = 2 << 20


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin.

    A text of fewer than k words, but not none, has one shingle: the whole sequence.
    """
    w = Words(texts, PLAIN, fold=True)
    h = w.hashes()
    n = len(w.n_words)
    docs, grams = [], []
    full = inside(w.first, w.n_words, k)
    g = gram_hashes(h, k)
    docs.append(w.doc[full])
    grams.append(g[full[:len(g)]])
    for size in range(1, k):
        short = np.flatnonzero(w.n_words == size)
        if len(short):
            docs.append(short)
            grams.append(gram_hashes(h, size, seed=size)[w.first[short]])
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    doc, gram = doc[fresh], gram[fresh]
    return gram, np.searchsorted(doc, np.arange(n + 1))


def signatures(gram: np.ndarray, first: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """2 * perms values for each text that has shingles: the minimum and maximum under each permutation."""
    full = np.flatnonzero(np.diff(first))
    out = np.empty((len(full), 2 * perms), np.uint64)
    if not len(full):
        return out
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**64, perms, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**64, perms, dtype=np.uint64)
    at = first[:-1][full]
    for k in range(perms):
        v = (gram ^ b[k]) * a[k]
        out[:, 2 * k] = np.minimum.reduceat(v, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, at)
    return out


def bands_of(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = sig.shape[1] // rows
    out = np.empty((len(sig), n), np.uint64)
    for j in range(n):
        h = np.full(len(sig), j + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, j * rows + r])
        out[:, j] = h
    return out


def sketch(docs: DataFrame, k: int = WORDS, perms: int = PERMS, rows: int = ROWS) -> DataFrame:
    """(doc_id, tkey, node, n_shingles, bands): tkey is a hash of the text, node a hash of the whole set, so equal sets are one node."""
    def go(it):
        for b in batches_of(PIECE_BYTES)(it):
            gram, first = shingle_sets(frame(b, "text"), k)
            size = np.diff(first)
            node = np.zeros(len(size), np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                node[full] = mix(np.add.reduceat(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][full]) + size[full].astype(np.uint64))
            bands = bands_of(signatures(gram, first, perms), rows)
            lengths = np.zeros(len(size) + 1, np.int32)
            lengths[full + 1] = bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [frame(b, "doc_id"), frame(b, "tkey"), pa.array(node.view(np.int64)), pa.array(size.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))],
                names=["doc_id", "tkey", "node", "n_shingles", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tkey")).mapInArrow(go, f"doc_id {kind}, tkey long, node long, n_shingles long, bands array<long>")


def star_edges(sketched: DataFrame) -> DataFrame:
    """(node, hub, n): every node of a band bucket with two or more nodes, and the bucket's smallest node."""
    nodes = sketched.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    keys = nodes.select("node", "n", F.explode("bands").alias("band"))
    hubs = keys.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("_far")).where("hub <> _far").drop("_far")
    return keys.join(hubs, "band").where("node <> hub").select("node", "hub", "n").distinct()


def _union(parent: list[int], a: int, b: int) -> None:
    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    a, b = root(a), root(b)
    if a != b:
        parent[max(a, b)] = min(a, b)


def star_links(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], hub: int, percent: int) -> list[tuple[int, int]]:
    """Links among a star's members, as (node, smaller node) rows of a spanning forest.

    node: sorted; side: 0 or 1, and 2 for the hub.  Only members of different sides are compared, or all if
    there is one side.  Members linked with the hub are connected anyhow and are not compared with one another.
    """
    m = len(node)
    size = np.array([len(s) for s in sets], np.int64)
    first = np.cumsum(size) - size
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(values), np.int64)
    parent = list(range(m))
    one_side = len(np.unique(side[side < 2])) < 2

    def similar(i):
        flag[ids[first[i]:first[i] + size[i]]] = 1
        both = np.add.reduceat(flag[ids], first)
        flag[ids[first[i]:first[i] + size[i]]] = 0
        return 100 * both >= percent * (size[i] + size - both)

    near = similar(hub)
    for i in np.flatnonzero(near).tolist():
        _union(parent, i, hub)
    for i in np.flatnonzero(~near).tolist():
        linked = similar(i)
        if not one_side:
            linked &= side != side[i]
        for j in np.flatnonzero(linked).tolist():
            if j != i:
                _union(parent, i, j)
    out = []
    for i in range(m):
        r = i
        while parent[r] != r:
            r = parent[r]
        if r != i:
            out.append((int(node[i]), int(node[r])))
    return out


def links(docs: DataFrame, sketched: DataFrame, k: int = WORDS, percent: int = PERCENT, star_weight: int = STAR_WEIGHT) -> DataFrame:
    """(a, b), nodes: a spanning forest of the links of each star, confirmed on whole sets."""
    edges = save(star_edges(sketched), "stars")
    # the hub belongs to its star; large stars are dealt out as pairs of blocks
    weight = edges.groupBy("hub").agg(F.sum("n").alias("_w"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_w") / F.lit(star_weight))).cast("int")
    stars = save(edges.select("node", "hub").unionByName(weight.select(F.col("hub").alias("node"), "hub"))
                 .join(weight.select("hub", parts.alias("parts")), "hub"), "members")
    wanted = stars.groupBy("node").agg(F.collect_set(F.struct("hub", "parts")).alias("stars"))
    one = (sketched.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tkey")).alias("first"))
           .select("node", "first.doc_id", "first.tkey"))
    # one document of each node brings its text
    need = wanted.join(one, "node").select("node", F.col("doc_id").alias("_id"), F.col("tkey").alias("_t"), "stars")
    texts = (docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
             .join(need, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_t"))).select("node", "text", "stars"))

    def deal(it):
        for b in batches_of(PIECE_BYTES)(it):
            gram, first = shingle_sets(frame(b, "text"), k)
            size = np.diff(first)
            full = np.flatnonzero(size)
            got = np.zeros(len(size), np.uint64)
            if len(full):
                got[full] = mix(np.add.reduceat(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), first[:-1][full]) + size[full].astype(np.uint64))
            got = got.view(np.int64)
            rows = []
            for i, (node, stars) in enumerate(zip(frame(b, "node").to_pylist(), frame(b, "stars").to_pylist(), strict=True)):
                if got[i] != node:  # another row of that doc_id
                    continue
                raw = gram[first[i]:first[i + 1]].tobytes()
                for s in stars:
                    p = s["parts"]
                    mine = int(mix(np.array([node], np.int64).view(np.uint64))[0] % np.uint64(p))
                    if p == 1:
                        rows.append((s["hub"], 0, 0, node, 2 if node == s["hub"] else 0, raw))
                    elif node == s["hub"]:
                        rows += [(s["hub"], x, y, node, 2, raw) for x in range(p) for y in range(x, p)]
                    else:
                        rows += [(s["hub"], min(x, mine), max(x, mine), node, int(mine > x), raw) for x in range(p)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                                             names=["hub", "x", "y", "node", "side", "grams"])

    dealt = texts.mapInArrow(deal, "hub long, x int, y int, node long, side int, grams binary")

    def confirm(key, tab):
        hub = key[0].as_py()
        node = tab["node"].to_numpy()
        _, at = np.unique(node, return_index=True)  # equal rows bring a node twice
        node, side = node[at], tab["side"].to_numpy()[at]
        raw = tab["grams"].to_pylist()
        pairs = star_links(node, side, [np.frombuffer(raw[i], np.uint64) for i in at.tolist()], int(np.searchsorted(node, hub)), percent) if len(node) > 1 else []
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return dealt.groupBy("hub", "x", "y").applyInArrow(confirm, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node of its component.

    Alternating large-star and small-star rounds; each round is written, and two sums are all the driver sees.
    """
    def both(e):
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = save(edges.where("a <> b"), "edges")
    before = state(e)
    while True:
        n = both(e).distinct()
        low = n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = n.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node with its smaller neighbours
        s = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = s.groupBy("u").agg(F.min("v").alias("m"))
        small = (s.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))).distinct()
        e = save(small, "edges")
        now = state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, star_weight: int = STAR_WEIGHT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row of docs (doc_id, text; other columns are not read).

    text_key is xxhash64 of the text, to tell rows with one doc_id apart.
    Documents are linked where 100 * intersection >= percent * union of their shingle sets.  component_id is the
    smallest doc_id reachable; kept: doc_id = component_id.  A text without words, or null, is linked with
    nothing.  A row without doc_id has the component of its text; where no row of it has a doc_id, null and kept.
    Rows with one doc_id and several texts are documents of their own.  No rows: no rows.
    """
    docs = docs.select("doc_id", "text")
    sketched = save(sketch(docs, k), "sketch")
    label = components(links(docs, sketched, k, percent, star_weight))
    rows = sketched.select("doc_id", F.col("tkey").alias("text_key"), "node", "n_shingles")
    full = rows.where("n_shingles > 0")
    # first the smallest id of each set, so that copies are one row before labels are joined
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("low")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lows = nodes.join(nodes.groupBy("label").agg(F.min("low").alias("component_id")), "label").select("node", "component_id")
    out = full.join(lows, "node").select("doc_id", "text_key", "n_shingles", "component_id").union(
        rows.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


OP4_SQL = f"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT rid, w, least({WORDS}, len(w)) AS k, unnest(range(1, len(w) - least({WORDS}, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= {PERCENT} * (nx.n + ny.n - c)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)"""

QUERIES = {"op4_minhash": op4_minhash}
ORACLE = {"op4_minhash": OP4_SQL}
