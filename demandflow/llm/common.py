"""Shared helpers of the text operators: table access, scratch tables, word tokenisation in numpy."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back (cuts lineage,
    survives lost executors)."""
    path = scratch_path(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts (one narrow aggregate); sizes partitions, never the result."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` is much faster than ``translate`` and equal to it on ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def row_key(*columns: str) -> list[Column]:
    """Two 64-bit hashes of a row's id and text; rows with equal keys are equal rows."""
    cols = [F.col(c) for c in columns]
    nulls = F.concat(*[F.isnull(c).cast("string") for c in cols])
    return [F.xxhash64(F.lit(1), nulls, *cols).alias("_k1"), F.xxhash64(F.lit(2), nulls, *cols).alias("_k2")]


# --- words in numpy -----------------------------------------------------------------------------

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: word bytes of `[^\x20\x09-\x0D]+`: all but the six spaces (bytes of longer characters are >= 0x80)
PLAIN = np.array([b not in SPACES for b in range(256)])
#: word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z, and all beyond ASCII
ALNUM = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_rng = np.random.default_rng(20240229)
#: A random value per byte: a word's hash is the sum of these times powers of BASE, modulo 2^64
BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept and grown per worker."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing (a bijection on 64 bits), so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a batch of texts.

    buf: bytes of all texts (folded where asked); offsets: text i is buf[offsets[i]:offsets[i+1]];
    start, end: byte places of each word; doc: its text; first: first[i]..first[i+1] are text i's words.
    Null texts have no bytes and no words.
    """

    def __init__(self, texts: pa.Array, member: np.ndarray, fold: bool):
        self.buf, self.offsets = text_buffer(texts)
        if fold:
            self.buf = FOLD[self.buf]
        n = len(self.buf)
        is_word = np.zeros(n + 1, bool)
        is_word[:n] = member[self.buf]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends = ~is_word
        ends[0] = False
        ends[1:] &= is_word[:-1]
        # a text's first byte starts a word even if the text before ended in one
        o = self.offsets[1:-1]
        o = o[(o > 0) & (o < n)]
        o = o[is_word[o]]
        cut = np.unique(o[is_word[o - 1]]) if len(o) else o
        begins[cut] = True
        ends[cut] = True
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, self.offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, equal for equal bytes wherever they stand."""
        v = BYTE[self.buf] * powers(BASE, len(self.buf))
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(v, out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(BASE_INV, len(self.buf) + 1)[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i]:self.end[i]].tobytes()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts, without copies; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    if off is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - lo


def gram_hashes(word_hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive words (across text borders too; the caller masks those)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = mix(np.array([seed * 2 + 0x51ED270B], np.uint64))[0] | np.uint64(1)
    inv = np.uint64(pow(int(base), -1, 2**64))
    total = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * powers(base, len(word_hashes)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(inv, n) + np.uint64(k))


def inside(first: np.ndarray, n_words: np.ndarray, k: int) -> np.ndarray:
    """Which word places start k words of one text."""
    total = int(first[-1]) if len(first) else 0
    left = np.repeat(first[1:], n_words) - np.arange(total)
    return left >= k


def covered(starts: np.ndarray, k, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + k) of some s; k: a number or one per start."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + k, -1)
    return np.cumsum(d[:n]) > 0


def batches_of(size: int, columns=("text",)):
    """Rebatch a mapInArrow iterator so that each piece holds about ``size`` bytes of text; a longer
    text is a piece of its own."""
    def go(it):
        for b in it:
            weight = np.zeros(b.num_rows, np.int64)
            for c in columns:
                weight += np.diff(text_buffer(b.column(b.schema.get_field_index(c)))[1])
            if b.num_rows == 0:
                continue
            piece = np.cumsum(weight) // size
            cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield b.slice(lo, hi - lo)
    return go


def frame(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def schema_with(docs: DataFrame, new: str):
    """The schema of docs plus the (nullable) columns of a DDL string."""
    from pyspark.sql.types import StructType

    return StructType([*docs.schema.fields, *StructType.fromDDL(new).fields])
