"""Tokenizer alignment against a plain merge of both token streams; the minimal perfect hash; odd input."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandflow.llm import alignment
from tests.llm.conftest import SCHEMA, edge_texts

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)


def odd_texts():
    return ["", None, " ", "  two  spaces ", "▁ mark", "<|endoftext|> and <s> </s> <unk> <0x0A>", "\x00nul\x00", "\n\n\t\r\n", "日本語テキスト 漢字かな交じり文",
            "😀😀👩‍👩‍👧 flags 🇩🇪", "x" * 3000, " " * 3000, "ab" * 2000, "ÀÉÎõü" * 300, "१२३ ٤٥٦", "don't they'll we've I'm", "é combining", "0123456789" * 50]


def brute(rows, encoders):
    a, b = encoders
    letters = alignment.byte_alphabet()
    raw_a = {i: bytes(letters[c] for c in s) for s, i in a.get_vocab().items() if s != "<|endoftext|>"}
    docs, df = [], Counter()
    for doc, text in rows:
        ta = a.encode(" " + text, add_special_tokens=False).ids if text else []
        tb = b.encode(text) if text else []
        ba = [raw_a[i] for i in ta]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in tb]
        if text and not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            ta = tb = []
        groups, ga, gb, ea, eb, i, j = [], [], [], 0, 0, 0, 0
        while i < len(ta) or j < len(tb):
            if ea <= eb:
                ga.append(ta[i])
                ea += len(ba[i])
                i += 1
            else:
                gb.append(tb[j])
                eb += len(bb[j])
                j += 1
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        links = Counter()
        for x, y in groups:
            for p, n in Counter(x).items():
                for q, m in Counter(y).items():
                    links[p, q] += n * m
        df.update(links.keys())
        docs.append((doc, len(ta), len(tb), groups, links))
    best = defaultdict(int)
    for (p, _), n in df.items():
        best[p] = max(best[p], n)
    out = []
    for doc, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, na, nb, len(groups), sum(links.values()), sum(n for (p, q), n in links.items() if df[p, q] == best[p]),
                    sum(n * df[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, df


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    return order(map(tuple, got)) == order(want)


def test_small_tables(spark, sf_dir, encoders):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], encoders)
    got = alignment.op13_alignment(spark, sf_dir)
    assert tuple(got.columns) == COLUMNS and same(got.collect(), want)


@pytest.mark.parametrize("limits", [{}, {"slice_pairs": 40, "chunk_pairs": 300, "fan": 2}])
def test_odd_texts_and_several_chunks(spark, encoders, limits):
    rows = list(enumerate([*odd_texts(), *edge_texts()])) + [(None, "same text"), (None, "same text"), (7, "seven again")]
    docs = spark.createDataFrame([(i, t, "pair", "cell", 0) for i, t in rows], SCHEMA).withColumnRenamed("source", "n_a").repartition(5)
    got, counts = alignment.align(docs, **limits)
    want, df = brute(rows, encoders)
    assert same(got.collect(), want)
    assert (len(counts.chunks) > 3) == bool(limits)
    assert {(r.a_id, r.b_id): r.n for r in counts.table().collect()} == dict(df)


def test_no_documents(spark, no_docs, odd_docs):
    assert alignment.align(no_docs)[0].collect() == []
    nothing = alignment.align(odd_docs.withColumn("text", F.lit(None).cast("string")))[0].collect()
    assert len(nothing) == 10 and all(r.n_a == r.n_links == 0 and r.groups_sha256 == "" for r in nothing)
    assert alignment.align(odd_docs)[0].count() == 10


def test_ranks_encode_as_the_library_does(spark, encoders):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    pair = alignment.Pair().open()
    texts = [t for t in [*docs, *odd_texts(), *edge_texts()] if t]
    for t, x in zip(texts, encoders[0].encode_batch([" " + t for t in texts], add_special_tokens=False), strict=True):
        assert pair.a.encode_to_numpy(" " + t, disallowed_special=()).tolist() == x.ids
    assert pair.by_words
    for t, (_, got) in zip(texts, pair.encode(texts), strict=True):
        want = encoders[1].encode(t)
        assert np.frombuffer(got, np.uint16).tolist() == (want if "▁" not in t else [])


@pytest.mark.parametrize("step_links,big_group", [(5, 1), (1 << 20, 3), (50, 1 << 30)])
def test_links_in_steps(encoders, step_links, big_group):
    """Any step of the expansion, and groups reduced to distinct ids or not, give the same links."""
    pair = alignment.Pair().open()
    texts = [t or "" for t in odd_texts()] + ["x" * 300 + " y"]
    ids = pair.encode(texts)
    batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in ids], pa.binary()) for k in (0, 1)], names=["a", "b"])
    got = alignment.Aligned(batch, pair, step_links, big_group).doc_pairs()
    have = {(int(p) // pair.n_b, int(p) % pair.n_b, int(d)): int(n) for p, d, n in zip(*got, strict=True)}
    want = {}
    for d, t in enumerate(texts):
        rows, df = brute([(d, t)], encoders)
        want[d] = (rows[0][4], set(df))
    for d in want:
        assert sum(n for (_, _, x), n in have.items() if x == d) == want[d][0]
        assert {(p, q) for p, q, x in have if x == d} == want[d][1]


def test_minimal_perfect_hash():
    r = np.random.default_rng(1)
    pairs = np.unique(r.integers(0, 50_257 * 32_000, 20_000))
    which = alignment.cells(pairs) * 5 // alignment.CELLS
    built = [alignment.build_hash(pairs[which == s]) for s in range(5)]
    h = alignment.PairHash(5, 0, [b[0] for b in built], [np.packbits(b[1], bitorder="little").tobytes() for b in built], [b[2].tobytes() for b in built])
    mine, slot = h.slots(pairs)
    assert len(mine) == len(pairs) and sorted(slot.tolist()) == list(range(len(pairs)))
    assert (h.keys[slot] == pairs).all()
    part = alignment.PairHash(5, 2, [b[0] for b in built[2:4]], [np.packbits(b[1], bitorder="little").tobytes() for b in built[2:4]], [b[2].tobytes() for b in built[2:4]])
    mine, slot = part.slots(pairs)
    assert (np.isin(which[mine], [2, 3])).all() and sorted(slot.tolist()) == list(range(len(mine)))
    with pytest.raises(KeyError):
        h.slots(np.setdiff1d(np.arange(3000), pairs))


def test_narrow_numbers():
    for top in (0, 255, 256, 65_536, 2**33):
        x = np.array([0, 1, top])
        assert alignment.widen(alignment.narrow(x)).tolist() == x.tolist()
