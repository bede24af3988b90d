"""Operator 7: SentencePiece encoding and decoding with a shared-prefix Viterbi search.

A text is cut into marked words: a run of spaces and the run of other characters after it (one space is put
before the text).  The distinct marked words of a batch are sorted, which lays them out as a trie
in depth-first order: a word shares with its predecessor all forward scores (and all pieces still
open) of their common prefix, and only the rest is computed.  No piece stands across words, so that the best path of
a text is that of its words, one after the other.

The vocabulary file (a parameter) is read on the driver and broadcast: it is of fixed size.  Its pieces are ranked,
but a BPE file's scores are merge ranks, not log probabilities that can be added up; ``log_probs`` derives
those from the ranks by Zipf's law.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from demandflow.llm.common import batches_of, frame, schema_with, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_BYTES = 4 << 20
#: Encoded words kept per Python worker; when they are more, they are forgotten and encoded anew as they come
MEMORY = 300_000
WORD = re.compile(" +[^ ]*|[^ ]+")


class Vocabulary:
    """pieces: (text with spaces as marks, id, log probability); byte_ids: the 256 ids of single bytes."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.unknown = min((p[2] for p in pieces), default=0.0) - 10.0
        self.raw = {i: p.encode() for p, i, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.root: dict = {}
        for text, i, score in pieces:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node[""] = (score, i)
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        texts = {i: sp.id_to_piece(i).replace("▁", " ") for i in normal}
        normal = [i for i in normal if " " not in texts[i].lstrip(" ")]  # within one marked word
        scores = log_probs([sp.get_score(i) for i in normal])
        return cls([(texts[i], i, s) for i, s in zip(normal, scores, strict=True)], [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """ids (4 bytes each) of each word; words: sorted and distinct.

        Of paths with equal scores the one with the longest last piece counts.  A character that is no piece
        is written as its UTF-8 bytes.
        """
        out, root, unknown, byte_ids = {}, self.root, self.unknown, self.byte_ids
        best, back, still_open, last = [0.0], [None], [[]], ""
        for word in words:
            n, p = min(len(word), len(last)), 0
            if word[:n] == last[:n]:
                p = n
            else:
                while word[p] == last[p]:
                    p += 1
            del best[p + 1:], back[p + 1:], still_open[p + 1:]
            for d in range(p, len(word)):
                c = word[d]
                top, link, alive = -math.inf, None, []
                for s, node in still_open[d]:
                    child = node.get(c)
                    if child is not None:
                        alive.append((s, child))
                        if "" in child and best[s] + child[""][0] > top:
                            top, link = best[s] + child[""][0], (s, child[""][1])
                child = root.get(c)
                if child is not None:
                    alive.append((d, child))
                if child is not None and "" in child:
                    if best[d] + child[""][0] > top:
                        top, link = best[d] + child[""][0], (d, child[""][1])
                elif best[d] + unknown > top:
                    top, link = best[d] + unknown, (d, None)
                best.append(top)
                back.append(link)
                still_open.append(alive)
            ids, d = [], len(word)
            while d:
                s, i = back[d]
                ids += [i] if i is not None else [byte_ids[b] for b in reversed(word[s:d].encode())]
                d = s
            out[word] = np.array(ids[::-1], np.int32).tobytes()
            last = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids (int32, little endian) of each text; an empty text has none."""
        split = [WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > MEMORY:
            self.known = {}
        new = {w for ws in split for w in ws}.difference(self.known)
        self.known.update(self.encode_words(sorted(new)))
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode()[1:]


def log_probs(file_scores: list[float]) -> list[float]:
    """Log probabilities by Zipf's law from the pieces' ranks (by falling file score, then by place)."""
    order = sorted(range(len(file_scores)), key=lambda i: (-file_scores[i], i))
    total = math.log(sum(1 / (r + 1) for r in range(len(order)))) if order else 0.0
    out = [0.0] * len(order)
    for r, i in enumerate(order):
        out[i] = -math.log(r + 1) - total
    return out


def encode_texts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs plus piece_ids (array<int>) and decoded (string, from the ids alone).

    docs: text and any other columns, kept; columns with the new names are replaced.  Null text: null ids and null
    decoded; empty text: no ids.  Every other text is decoded to itself, marks, line ends and characters outside the
    vocabulary included.  One narrow pass.
    """
    docs = docs.drop("piece_ids", "decoded")
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    schema = schema_with(docs, "piece_ids array<int>, decoded string")

    def go(it):
        v = known.value
        for b in batches_of(PIECE_BYTES)(it):
            texts = frame(b, "text")
            nulls = np.array([not x for x in texts.is_valid().to_pylist()])
            ids = v.encode(texts.fill_null("").to_pylist())
            at = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.ListArray.from_arrays(pa.array(at), values, mask=pa.array(nulls)),
                 pa.array([None if z else v.decode(x) for x, z in zip(ids, nulls, strict=True)], pa.string())],
                names=[*b.schema.names, "piece_ids", "decoded"])

    return docs.mapInArrow(go, schema)


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), round_trip; null text: no pieces.

    The same pass as ``encode_texts``, but only digests leave the Python workers.
    """
    known = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    kind = dict(docs.dtypes)["doc_id"]

    def go(it):
        v = known.value
        for b in batches_of(PIECE_BYTES)(it):
            texts = frame(b, "text").fill_null("").to_pylist()
            ids = v.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [frame(b, "doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([v.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_())],
                names=["doc_id", "n_pieces", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(go, f"doc_id {kind}, n_pieces long, ids_sha256 string, round_trip boolean")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document text."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE: dict = {}
