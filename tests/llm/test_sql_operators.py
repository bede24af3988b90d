"""Operators that SQL can express: equal to their SQL on the fixtures, and defined on odd input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from demandflow import llm
from demandflow.llm import decontaminate, linededup, lm, minhash, substrings
from tests.compare import compare, duck

llm.load()
NAMES = sorted(llm.ORACLE)


def edge_duck(d):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_small_tables(spark, sf_dir, name):
    assert not compare(llm.QUERIES[name](spark, sf_dir), duck(sf_dir), llm.ORACLE[name])


@pytest.mark.parametrize("name", NAMES)
def test_edge_texts(spark, edge_dir, name):
    assert not compare(llm.QUERIES[name](spark, edge_dir), edge_duck(edge_dir), llm.ORACLE[name])


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 3)])
def test_line_runs_of_any_shape(spark, edge_dir, batches, fanout):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = linededup.dedup_lines(docs, batches=batches, fanout=fanout).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
    assert not compare(got, edge_duck(edge_dir), linededup.OP8_SQL)


def test_lines_of_odd_documents(odd_docs):
    rows = linededup.dedup_lines(odd_docs.withColumn("n_lines", F.lit("mine"))).collect()
    assert len(rows) == 10 and all(r.n_dropped >= 0 for r in rows)
    kept = {(r.doc_id, r.text): r.kept_text for r in rows}
    assert kept[(7, "This is a line\nThis is a line\nok")] == "This is a line\nThis is a line\nok"  # the owner keeps all
    assert kept[(8, "this is a line")] == "" and kept[(5, None)] == ""


def test_lines_under_text_ids(spark, odd_docs):
    """Ids that are texts or dates give what numbers in the same order give."""
    docs = odd_docs.select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(100 + i, f"This is a line\nown line of {i // 2}") for i in range(40)], "doc_id long, text string"))
    want = sorted((r.text or "", r.kept_text, r.n_dropped) for r in linededup.dedup_lines(docs, batches=3).collect())
    for other in (F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.date_add(F.lit("2020-01-01"), F.col("doc_id").cast("int"))):
        named = docs.withColumn("doc_id", other)
        assert sorted((r.text or "", r.kept_text, r.n_dropped) for r in linededup.dedup_lines(named, batches=3).collect()) == want


def test_stars_in_blocks(spark, edge_dir):
    """Large stars dealt out as pairs of blocks give the same components."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = minhash.near_duplicates(docs, star_weight=150).drop("text_key")
    assert not compare(got, edge_duck(edge_dir), minhash.OP4_SQL)


def test_near_duplicates_of_odd_documents(odd_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert by[(None, 2)].component_id == 5 and not by[(None, 2)].kept
    assert by[(None, 0)].component_id is None and by[(None, 0)].kept and by[(5, 0)].kept and by[(6, 0)].component_id == 6


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("chunk_bytes", [200, 2000])
def test_benchmark_in_chunks(spark, edge_dir, chunk_bytes):
    docs, items = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    f = decontaminate.contaminated(docs, items, chunk_bytes=chunk_bytes)
    got = f.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")
    assert not compare(got, edge_duck(edge_dir), decontaminate.OP10_SQL)


def test_hits_of_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(None, "c d e"), (None, None)], "item_id long, text string")
    rows = decontaminate.contaminated(odd_docs, items).collect()
    assert {r.text: r.n_hit for r in rows if r.text and r.text.startswith("a b")} == {"a b c d e f": 3}
    assert {tuple(r.hit_items) for r in rows} == {(), ("null",)}
    assert decontaminate.contaminated(odd_docs, items.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.contaminated(no_docs, items).isEmpty()


@pytest.mark.parametrize("hot,block_words", [(2, 3000), (3, 400), (100, 500)])
def test_blocks_of_any_size(spark, edge_dir, hot, block_words):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = substrings.remove_repeats(docs, hot=hot, block_words=block_words).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    assert not compare(got, edge_duck(edge_dir), substrings.OP6_SQL)


def test_hot_blocks_of_documents(spark):
    """On a table with longer repeats, every dealing of hot anchors gives the result of one block."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = substrings.remove_repeats(docs).select("doc_id", "kept_text")
    many = substrings.remove_repeats(docs, hot=2, block_words=5000).select("doc_id", "kept_text")
    assert one.exceptAll(many).isEmpty() and one.count() == many.count()


def test_repeated_rows_repeat_one_another(spark, odd_docs):
    text = " ".join(f"x{i}" for i in range(40))
    docs = odd_docs.unionByName(spark.createDataFrame([(None, text, 1, "a"), (None, text, 1, "a")], odd_docs.schema))
    rows = substrings.remove_repeats(docs).collect()
    assert len(rows) == 12 and [r.n_removed for r in rows if r.text == text] == [40, 40]


@pytest.mark.parametrize("block_bytes,grams", [(300, 50), (20_000, 1000)])
def test_counts_in_parts(spark, edge_dir, block_bytes, grams):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    got = lm.score_documents(docs, block_bytes=block_bytes, grams_per_partition=grams).select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"))
    assert not compare(got, edge_duck(edge_dir), lm.OP1_SQL)


def test_nothing_in_nothing_out(spark, odd_docs, no_docs):
    assert lm.score_documents(no_docs).isEmpty()
    assert substrings.remove_repeats(no_docs).isEmpty()
    assert minhash.near_duplicates(no_docs).isEmpty()
    assert linededup.dedup_lines(no_docs).isEmpty()
    assert lm.score_documents(odd_docs).count() == 10
