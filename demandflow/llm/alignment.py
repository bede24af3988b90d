"""Operator 13: alignment of two tokenizers over a corpus.

Every text is encoded by both tokenizers once; the ids are written, compactly.  Byte offsets at which a token of each
ends cut the text into groups; every token of one tokenizer is linked with every token of the other in its group.

Counting (in how many documents an id pair is linked) goes by a minimal perfect hash:

1. tasks give the pairs of their documents, each with its number of documents; Spark makes them distinct over the corpus;
2. pairs are dealt to slices by a hash; a task per slice builds its minimal perfect hash (levels of bit arrays: a pair that is
   alone at its place of a level stays there, the others go on to the next; a pair's number is the rank of its bit), and
   puts the pairs in this order, the keys against which each look-up is verified;
3. per chunk of slices (a bounded number of pairs), tasks add those numbers up in a dense vector indexed by the hash;
   the vectors are summed slice by slice in a tree, so that no task ever gets more than ``FAN`` vectors of a slice;
4. a second pass aligns the documents again and looks the counts up.

What is broadcast is a chunk: at most ``CHUNK_PAIRS`` pairs with their bits, keys and counts.  A corpus of more distinct pairs
takes one more pass over the ids per chunk; the number of chunks is bounded by the vocabularies' sizes, not by the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import batches_of, frame, mix, scratch_path, table
from demandflow.llm.variants import spread

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
TEXT_BYTES = 1 << 20
#: Tokens that a task aligns at a time (a longer document is a piece of its own)
PIECE_TOKENS = 1 << 19
#: Links of one step of the expansion
STEP_LINKS = 1 << 22
#: Groups with more links are reduced to distinct ids with their numbers first
BIG_GROUP = 256
SLICE_PAIRS = 1 << 17
CHUNK_PAIRS = 1 << 22
#: Distinct pairs that a task holds before it gives them away
HELD_PAIRS = 1 << 22
FAN = 8
#: Rows of task counts that go to one leaf of the tree of sums, if there are enough leaves for all cores
LEAF_ROWS = 1 << 24
CELLS = 1 << 16
#: Bits per key of a level
GAMMA = 2
#: Marked words whose B ids a Python worker keeps, and the longest of them; when there are more, all are forgotten and encoded as they come
MEMORY, KEPT_CHARS = 300_000, 64
#: A run of spaces and the other characters after it
MARKED = re.compile(" +[^ ]*")


# --- tokenizers ------------------------------------------------------------------------------------

def byte_alphabet() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes its bytes as: printable ones stand for themselves, the others
    for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, made of their files' contents (so that tasks need no file).

    A: a byte-level BPE file of the tokenizers library.  Its merges are in the order of their results' ids, so that the same BPE
    runs on ranks (tiktoken's encoder, several times as fast; equality is tested).  Strings of special tokens in a text
    are plain text.  B: a SentencePiece model with byte fallback that puts a space before the text.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the byte-level rule of the A file

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE):
        with open(a_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, rule = spec["model"], spec["pre_tokenizer"]
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first = len(vocab) - len(merges)
        if (rule["type"], rule["add_prefix_space"], rule["use_regex"]) != ("ByteLevel", False, True) or spec["normalizer"] or any(
                vocab[a + b] != first + i for i, (a, b) in enumerate(merges)):
            raise ValueError("not a plain byte-level BPE file whose merges are in the order of the ids")
        letters = byte_alphabet()
        special = {t["id"] for t in spec["added_tokens"]}
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i not in special}
        with open(b_file, "rb") as f:
            self.b_model = f.read()
        self.n_a = max([*self.a_bytes, *special]) + 1
        self.n_b = self._piece_model().get_piece_size()
        self.key = hashlib.sha256(json.dumps([vocab, merges]).encode() + self.b_model).hexdigest()

    def _piece_model(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    _open: dict = {}

    def open(self) -> Pair:
        """Loads the encoders (once per Python worker)."""
        if self.key not in Pair._open:
            import tiktoken

            self.a = tiktoken.Encoding(self.key, pat_str=self.PATTERN, mergeable_ranks={t: i for i, t in self.a_bytes.items()},
                                       special_tokens={})
            self.b = b = self._piece_model()
            self.a_raw = [self.a_bytes.get(i, b"") for i in range(self.n_a)]
            self.b_raw = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                          for i in range(self.n_b)]
            self.len_a, self.len_b = np.array([len(x) for x in self.a_raw]), np.array([len(x) for x in self.b_raw])
            # where no piece has a space after another character, no merge crosses the start of a run of spaces, and a text's ids are
            # those of its marked words
            self.by_words = all("▁" not in b.id_to_piece(i).lstrip("▁") for i in range(self.n_b) if not b.is_control(i) and not b.is_unknown(i))
            self.mark, self.words, self.misspelt = b.piece_to_id("▁"), {}, set()
            Pair._open = {self.key: self}
        return Pair._open[self.key]

    @property
    def width(self):
        return np.uint16 if max(self.n_a, self.n_b) <= 1 << 16 else np.uint32

    def _encode_words(self, words: list[str]) -> None:
        """Keeps the ids of marked words, and which of them their pieces do not spell."""
        ids = self.b.encode([w[1:] for w in words], num_threads=1)
        for w, x in zip(words, ids, strict=True):
            x = x or [self.mark]  # a single space: the library adds none to an empty text
            self.words[w] = np.array(x, self.width).tobytes()
            if b"".join(map(self.b_raw.__getitem__, x)) != w.encode():
                self.misspelt.add(w)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(A ids, B ids) of each text, as numbers of ``width``; none where one of them does not spell space + text."""
        marked = [MARKED.findall(" " + t) if t else [] for t in texts] if self.by_words else [[" " + t] if t else [] for t in texts]
        if len(self.words) > MEMORY:
            self.words, self.misspelt = {}, set()
        self._encode_words(list({w for ws in marked for w in ws}.difference(self.words)))
        out = []
        for t, ws in zip(texts, marked, strict=True):
            b = b"".join(map(self.words.__getitem__, ws))
            a = self.a.encode_to_numpy(" " + t, disallowed_special=()) if t else np.zeros(0, np.int64)
            # every byte is a token of A, so that its tokens spell any text; the length is looked at all the same
            ok = t and (not self.misspelt or self.misspelt.isdisjoint(ws)) and int(self.len_a[a].sum()) == len(t.encode()) + 1
            out.append((a.astype(self.width).tobytes(), b) if ok else (b"", b""))
        for w in [w for w in self.words if len(w) > KEPT_CHARS]:
            del self.words[w]
            self.misspelt.discard(w)
        return out


def encode_both(docs: DataFrame, pair: Pair) -> DataFrame:
    """_row (a number of its own for each row), doc_id, a, b: the ids of docs' texts, 16 or 32 bits each, written once."""
    known = docs.sparkSession.sparkContext.broadcast(pair)
    kind = dict(docs.dtypes)["doc_id"]

    def go(it):
        p = known.value.open()
        for batch in batches_of(TEXT_BYTES)(it):
            ids = p.encode(frame(batch, "text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [frame(batch, "_row"), frame(batch, "doc_id"), *[pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1)]],
                names=["_row", "doc_id", "a", "b"])

    path = scratch_path(docs.sparkSession, "tokens")
    out = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text").mapInArrow(go, f"_row long, doc_id {kind}, a binary, b binary")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


# --- alignment of a piece of documents ------------------------------------------------------------

def ids_of(column: pa.Array, width) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and the number of ids of each row."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    if not len(column) or off is None:
        return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].tobytes() if data is not None else b""
    return np.frombuffer(raw, width).astype(np.int64), np.diff(offsets) // np.dtype(width).itemsize


class Aligned:
    """The groups and links of a piece of documents."""

    def __init__(self, batch: pa.RecordBatch, pair: Pair, step_links: int = STEP_LINKS, big_group: int = BIG_GROUP):
        self.pair, self.step_links, self.big_group = pair, step_links, big_group
        self.a, self.n_a = ids_of(frame(batch, "a"), pair.width)
        self.b, self.n_b = ids_of(frame(batch, "b"), pair.width)
        end_a, end_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        size = int(end_a[-1]) if len(end_a) else 0  # both spell the same bytes
        cut = np.zeros(size + 1, bool)
        cut[end_a] = True
        other = np.zeros(size + 1, bool)
        other[end_b] = True
        cuts = np.cumsum(cut & other)
        self.group_a, self.group_b = cuts[end_a - 1], cuts[end_b - 1]
        n = int(cuts[-1])
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.doc = np.repeat(np.arange(len(self.n_a)), self.n_a)[np.searchsorted(self.group_a, np.arange(n))]  # of each group
        self.n_groups = np.bincount(self.doc, minlength=len(self.n_a))
        self.n_links = whole_sums(self.doc, self.size_a * self.size_b, len(self.n_a))

    def doc_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, document, number of links) of the distinct ones, in this order; pair = A id * B's vocabulary + B id."""
        docs = max(1, len(self.n_a))
        links = self.size_a * self.size_b
        small = links <= self.big_group
        ones = small[self.group_a]
        found = [self._expand(self.a[ones], self.group_a[ones], None, self.b, self.group_b, None, docs)]
        if not small.all():
            big_a, big_b = ~ones, ~small[self.group_b]
            a, times_a = np.unique(self.group_a[big_a] * self.pair.n_a + self.a[big_a], return_counts=True)
            b, times_b = np.unique(self.group_b[big_b] * self.pair.n_b + self.b[big_b], return_counts=True)
            found.append(self._expand(a % self.pair.n_a, a // self.pair.n_a, times_a, b % self.pair.n_b, b // self.pair.n_b, times_b, docs))
        key, times = merge_counts([k for k, _ in found], [t for _, t in found])
        return key // docs, key % docs, times

    def _expand(self, a, group_a, times_a, b, group_b, times_b, docs: int):
        """All links of A tokens with the B tokens of their group, a bounded number at a time."""
        n_groups = len(self.size_a)
        first = np.searchsorted(group_b, np.arange(n_groups + 1))
        n = (first[1:] - first[:-1])[group_a]
        total = np.cumsum(n)
        keys, times = [], []
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + self.step_links, side="right")))
            at = np.repeat(np.arange(lo, hi), n[lo:hi])
            to = spread(first[group_a[lo:hi]], n[lo:hi])
            key = (a[at] * self.pair.n_b + b[to]) * docs + self.doc[group_a[at]]
            if times_a is None:
                key, count = np.unique(key, return_counts=True)
            else:
                key, count = merge_counts([key], [times_a[at] * times_b[to]])
            keys.append(key)
            times.append(count)
            lo = hi
        return merge_counts(keys, times) if len(keys) != 1 else (keys[0], times[0])

    def digests(self, written: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """groups_sha256 of each document; written: ``written_ids``."""
        if not len(self.a):
            return [""] * len(self.n_a)
        before_b = np.searchsorted(self.group_b, self.group_a)
        upto_a = np.searchsorted(self.group_a, self.group_b, side="right")
        last_a = np.r_[self.group_a[1:] != self.group_a[:-1], True]
        last_b = np.r_[self.group_b[1:] != self.group_b[:-1], True]
        na, nb = self.pair.n_a, self.pair.n_b
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + before_b] = self.a + np.where(last_a, na, 0)
        order[np.arange(len(self.b)) + upto_a] = self.b + 2 * na + np.where(last_b, nb, 0)
        letters, size = written
        length = size[order]
        text = letters[order][np.arange(letters.shape[1]) < length[:, None]].tobytes()
        ends = np.r_[0, np.cumsum(length)][np.r_[0, np.cumsum(self.n_a + self.n_b)]].tolist()
        return [hashlib.sha256(text[lo:hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def written_ids(pair: Pair) -> tuple[np.ndarray, np.ndarray]:
    """(letters, lengths) of every id of A with a comma, with a bar, and of every id of B with a comma, with a semicolon."""
    text = [f"{i}{mark}".encode() for size, marks in ((pair.n_a, ",|"), (pair.n_b, ",;")) for mark in marks for i in range(size)]
    size = np.array([len(t) for t in text])
    letters = np.zeros((len(text), int(size.max())), np.uint8)
    letters[np.arange(letters.shape[1]) < size[:, None]] = np.frombuffer(b"".join(text), np.uint8)
    return letters, size


def whole_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of values by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


def merge_counts(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    if len(keys) == 1 and (len(keys[0]) < 2 or (np.diff(keys[0]) > 0).all()):
        return keys[0], times[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, whole_sums(inverse, np.concatenate(times), len(key))


def token_pieces(it, size: int = PIECE_TOKENS):
    """Rebatches rows of ids so that a piece has some ``size`` tokens of both."""
    for b in it:
        if b.num_rows:
            weight = sum(pc.binary_length(frame(b, c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "b"))
            piece = np.cumsum(weight) // (2 * size)
            cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield b.slice(lo, hi - lo)


# --- minimal perfect hash ---------------------------------------------------------------------------

def cells(pair: np.ndarray) -> np.ndarray:
    """The cell (of CELLS) that a pair's slice is told by."""
    return (mix(pair.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def place(pair: np.ndarray, level: int, size) -> np.ndarray:
    """The bit that a pair takes on a level of ``size`` bits."""
    seed = mix(np.array([level * 2 + 1], np.uint64))[0]
    return (mix(pair.astype(np.uint64) ^ seed) % np.asarray(size).astype(np.uint64)).astype(np.int64)


def build_hash(pairs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits, pairs in the order of their numbers) of distinct pairs."""
    sizes, bits, owners = [], [], []
    left = pairs
    while len(left):
        size = -(-max(64, GAMMA * len(left)) // 64) * 64
        at = place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        own = np.zeros(size, np.int64)
        stays = alone[at]
        own[at[stays]] = left[stays]
        sizes.append(size)
        bits.append(alone)
        owners.append(own[alone])
        left = left[~stays]
    join = np.concatenate
    return sizes, join(bits) if bits else np.zeros(0, bool), join(owners) if owners else np.zeros(0, np.int64)


class PairHash:
    """The minimal perfect hash of a chunk: slices lo..hi-1 of ``n_slices``, their bits one after the other."""

    def __init__(self, n_slices: int, lo: int, sizes: list[list[int]], bits: list[bytes], keys: list[bytes]):
        self.n_slices, self.lo, self.hi = n_slices, lo, lo + len(sizes)
        depth = max(map(len, sizes), default=0)
        self.sizes = np.zeros((len(sizes), depth), np.int64)
        for s, x in enumerate(sizes):
            self.sizes[s, :len(x)] = x
        starts = np.cumsum(self.sizes.ravel()) - self.sizes.ravel()
        self.starts = starts.reshape(self.sizes.shape)
        self.words = np.frombuffer(b"".join(bits), np.uint64)
        per = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(per) - per
        self.keys = np.frombuffer(b"".join(keys), np.int64)
        self.slice_first = np.r_[0, np.cumsum([len(k) // 8 for k in keys])].astype(np.int64)

    def slots(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs are of this chunk, their numbers), verified against the keys."""
        which = cells(pairs) * self.n_slices // CELLS
        mine = np.flatnonzero((which >= self.lo) & (which < self.hi))
        pair, which = pairs[mine], which[mine] - self.lo
        slot = np.full(len(pair), -1, np.int64)
        left = np.arange(len(pair))
        for level in range(self.sizes.shape[1]):
            size = self.sizes[which[left], level]
            left, size = left[size > 0], size[size > 0]
            bit = self.starts[which[left], level] + place(pair[left], level, size)
            word, off = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> off) & np.uint64(1) > 0
            below = word[hit] & ((np.uint64(1) << off[hit]) - np.uint64(1))
            slot[left[hit]] = self.rank[bit[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        if len(left) or (self.keys[slot] != pair).any():
            raise KeyError("a pair that the counted documents do not have")
        return mine, slot


class PairCounts:
    """Distinct pairs and their document counts, as chunks of slices.

    slices: (slice, sizes array<int>, bits, keys) written per slice; counts: (slice, counts) written, 64-bit numbers in the
    keys' order; chunks: ranges of slices with at most CHUNK_PAIRS pairs."""

    def __init__(self, tokens: DataFrame, pair: Pair, slice_pairs: int = SLICE_PAIRS, chunk_pairs: int = CHUNK_PAIRS, fan: int = FAN):
        self.spark, self.pair = tokens.sparkSession, pair
        self.known = self.spark.sparkContext.broadcast(pair)
        sparse = _save(task_counts(tokens, self.known), "task_counts")
        distinct = _save(sparse.select("cell", "pair").distinct(), "pairs")
        total = distinct.count()
        self.n_slices = max(1, min(CELLS, -(-total // slice_pairs)))
        self.slices = _save(hash_slices(distinct, self.n_slices), "pair_hash")
        sizes = {r["slice"]: r.n for r in self.slices.select("slice", (F.octet_length("keys") / 8).cast("long").alias("n")).collect()}
        self.chunks, lo, held = [], 0, 0
        for s in range(self.n_slices):
            if held and held + sizes.get(s, 0) > chunk_pairs:
                self.chunks.append((lo, s))
                lo, held = s, 0
            held += sizes.get(s, 0)
        self.chunks.append((lo, self.n_slices))
        counts = None
        for chunk in self.chunks:
            one = _save(tree_sums(leaf_counts(sparse, self.hash(chunk)), leaves(sparse), fan), "pair_counts")
            counts = one if counts is None else counts.unionByName(one)
        self.counts = counts

    def _rows(self, df: DataFrame, chunk) -> list:
        return df.where((F.col("slice") >= chunk[0]) & (F.col("slice") < chunk[1])).orderBy("slice").collect()

    def hash(self, chunk) -> PairHash:
        """The hash of a chunk: its bits and keys pass the driver, CHUNK_PAIRS at most."""
        have = {r["slice"]: r for r in self._rows(self.slices, chunk)}
        rows = [have.get(s) for s in range(*chunk)]
        return PairHash(self.n_slices, chunk[0], [list(r.sizes) if r else [] for r in rows],
                        [bytes(r.bits) if r else b"" for r in rows], [bytes(r["keys"]) if r else b"" for r in rows])

    def counts_of(self, chunk) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r["counts"]) for r in self._rows(self.counts, chunk)), np.int64)

    def table(self) -> DataFrame:
        """(a_id, b_id, n): the alignment table, one row per linked pair of ids."""
        n_b = self.pair.n_b

        def go(it):
            for b in it:
                for r in b.to_pylist():
                    key, n = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key // n_b), pa.array(key % n_b), pa.array(n)], names=["a_id", "b_id", "n"])

        return self.slices.join(self.counts, "slice").select("keys", "counts").mapInArrow(go, "a_id long, b_id long, n long")

    def best(self) -> np.ndarray:
        """The highest count of each A id's pairs (at most as many numbers as A has ids)."""
        out = np.zeros(self.pair.n_a, np.int64)
        for r in self.table().groupBy("a_id").agg(F.max("n").alias("n")).collect():
            out[r.a_id] = r.n
        return out


def _save(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_counts(tokens: DataFrame, known) -> DataFrame:
    """(cell, pair, n): the pairs linked in a task's documents, with the number of these documents."""
    def go(it):
        p = known.value.open()
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def given():
            return pa.RecordBatch.from_arrays([pa.array(cells(held[0]).astype(np.int32)), pa.array(held[0]), pa.array(held[1])], names=["cell", "pair", "n"])

        for piece in token_pieces(it):
            pair = Aligned(piece, p).doc_pairs()[0]
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else pair
            held = merge_counts([held[0], pair[starts]], [held[1], np.diff(np.r_[starts, len(pair)])])
            if len(held[0]) > HELD_PAIRS:
                yield given()
                held = (held[0][:0], held[1][:0])
        yield given()

    return tokens.select("a", "b").mapInArrow(go, "cell int, pair long, n long")


def hash_slices(distinct: DataFrame, n_slices: int) -> DataFrame:
    """(slice, sizes, bits, keys): the minimal perfect hash of every slice that has pairs."""
    def go(t: pa.Table) -> pa.Table:
        sizes, bits, keys = build_hash(t["pair"].to_numpy())
        return pa.table({"slice": t["slice"][:1].cast(pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
                         "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())})

    named = distinct.select(F.floor(F.col("cell") * F.lit(n_slices) / CELLS).cast("int").alias("slice"), "pair")
    return named.groupBy("slice").applyInArrow(go, "slice int, sizes array<int>, bits binary, keys binary")


def leaves(sparse: DataFrame) -> int:
    """Leaves of the tree of sums: one for each core, more where these would get more than LEAF_ROWS rows."""
    return max(sparse.sparkSession.sparkContext.defaultParallelism, -(-sparse.count() // LEAF_ROWS))


def leaf_counts(sparse: DataFrame, pair_hash: PairHash) -> DataFrame:
    """(slice, node, counts): each leaf's dense vector of document counts, cut by slice."""
    held = sparse.sparkSession.sparkContext.broadcast(pair_hash)

    def go(it):
        h = held.value
        total = np.zeros(len(h.keys), np.int64)
        for b in it:
            mine, slot = h.slots(frame(b, "pair").to_numpy())
            np.add.at(total, slot, frame(b, "n").to_numpy()[mine])
        node = TaskContext.get().partitionId()
        for s in range(h.hi - h.lo):
            part = total[h.slice_first[s]:h.slice_first[s + 1]]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([h.lo + s], pa.int32()), pa.array([node], pa.int32()), pa.array([narrow(part)], pa.binary())],
                                                 names=["slice", "node", "counts"])

    return sparse.select("pair", "n").coalesce(leaves(sparse)).mapInArrow(go, "slice int, node int, counts binary")


def narrow(x: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(x.max(initial=0)) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def tree_sums(leaf: DataFrame, n_leaves: int, fan: int = FAN) -> DataFrame:
    """(slice, counts): vectors of a slice summed ``fan`` at a time, level by level."""
    def go(t: pa.Table) -> pa.Table:
        total = sum(widen(v) for v in t["counts"].to_pylist())
        return pa.table({"slice": t["slice"][:1], "node": t["node"][:1], "counts": pa.array([narrow(total)], pa.binary())})

    level = leaf
    while n_leaves > 1:
        n_leaves = -(-n_leaves // fan)
        level = (level.select("slice", F.floor(F.col("node") / fan).cast("int").alias("node"), "counts")
                 .groupBy("slice", "node").applyInArrow(go, "slice int, node int, counts binary"))

    def plain(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([frame(b, "slice"), pa.array([widen(v).tobytes() for v in frame(b, "counts").to_pylist()], pa.binary())],
                                             names=["slice", "counts"])

    return level.select("slice", "counts").mapInArrow(plain, "slice int, counts binary")


# --- second pass --------------------------------------------------------------------------------------

def look_up(tokens: DataFrame, counts: PairCounts, chunk, best, whole: bool) -> DataFrame:
    """_row, n_best, count_sum over the links whose pair is of the chunk; with ``whole`` also what goes by no count."""
    sc = tokens.sparkSession.sparkContext
    held = sc.broadcast((counts.hash(chunk), counts.counts_of(chunk), best))
    known = counts.known
    kind = dict(tokens.dtypes)["doc_id"]

    def go(it):
        p, (h, count, top) = known.value.open(), held.value
        written = None
        for piece in token_pieces(it):
            x = Aligned(piece, p)
            pair, doc, times = x.doc_pairs()
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else pair
            mine, slot = h.slots(pair[starts])
            n = np.zeros(len(starts), np.int64)
            n[mine] = count[slot]
            is_best = np.zeros(len(starts), bool)
            is_best[mine] = n[mine] == top[pair[starts][mine] // p.n_b]
            run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pair)]))
            docs = len(x.n_a)
            out = {"_row": frame(piece, "_row"), "n_best": pa.array(whole_sums(doc, np.where(is_best[run], times, 0), docs)),
                   "count_sum": pa.array(whole_sums(doc, n[run] * times, docs))}
            if whole:
                if written is None:
                    written = written_ids(p)
                out |= {"doc_id": frame(piece, "doc_id"), "n_a": pa.array(x.n_a.astype(np.int64)), "n_b": pa.array(x.n_b.astype(np.int64)),
                        "n_groups": pa.array(x.n_groups.astype(np.int64)), "n_links": pa.array(x.n_links),
                        "groups_sha256": pa.array(x.digests(written), pa.string())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "_row long, n_best long, count_sum long"
    if whole:
        schema += f", doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return tokens.mapInArrow(go, schema)


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, **limits) -> tuple[DataFrame, PairCounts]:
    """(documents' figures, pair counts) of docs.

    docs: doc_id, text; other columns, whatever their names, play no part.  The first frame has one row per row of docs: doc_id,
    n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; ``PairCounts.table`` is the alignment table (a_id, b_id, n).
    Null and empty texts, and texts that one of the tokenizers does not spell out as space + text, have no tokens: zeros and ''.
    Repeated rows and rows without doc_id count as documents of their own.  Ties of the highest count all count as best.  A text of
    any length is aligned whole; its links are expanded STEP_LINKS at a time, long groups by their distinct ids.
    """
    pair = Pair(a_file, b_file)
    tokens = encode_both(docs.select("doc_id", "text"), pair)
    counts = PairCounts(tokens, pair, **limits)
    best = counts.best()
    out = look_up(tokens, counts, counts.chunks[0], best, True)
    more = None
    for chunk in counts.chunks[1:]:
        one = look_up(tokens, counts, chunk, best, False)
        more = one if more is None else more.unionByName(one)
    if more is not None:
        more = more.groupBy("_row").agg(F.sum("n_best").alias("_best"), F.sum("count_sum").alias("_sum"))
        out = out.join(more, "_row").withColumns({"n_best": F.col("n_best") + F.col("_best"), "count_sum": F.col("count_sum") + F.col("_sum")})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both vocabularies over the whole texts of documents."""
    return align(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op13_alignment": op13_alignment}
ORACLE: dict = {}
