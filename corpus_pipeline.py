"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  ``run`` applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm import decontaminate, linededup, minhash, pieces, quality
from demandflow.llm.common import save, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, the text replaced and its length renewed."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in COLUMNS])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs are certified on the labels of the stage's documents."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document of smaller doc_id holds, too."""
    return _with_text(linededup.dedup_lines(docs), "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest doc_id.

    Rows without doc_id stay unless a row with one is in their class; of equal rows one stays.
    """
    classes = save(minhash.near_duplicates(docs), "classes")
    gone = classes.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    kept = docs.join(gone, same, "left_anti")
    if not classes.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 and round_trip of every document's SentencePiece ids."""
    return pieces.digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: The quality cutoffs and the piece search are not SQL; tests/llm checks every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
