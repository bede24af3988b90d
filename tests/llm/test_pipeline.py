"""Every stage of the pipeline against brute force over what its predecessor kept."""

import re

import corpus_pipeline
from demandflow.llm import quality
from demandflow.llm.pieces import Vocabulary


def lowered(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0D]+", lowered(t))
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_lines(docs):
    keys = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            k = lowered(x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 10:
                keys.setdefault(k, set()).add(i)
    return {(i, "\n".join(x for x in (t or "").split("\n")
                          if (k := lowered(x.strip(" \t\n\x0b\x0c\r"))) not in keys or len(keys[k]) < 2 or min(keys[k]) == i)) for i, t in docs}


def brute_near(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {(i, t) for i, t in docs if label[i] == i}


def brute_clean(docs, items):
    def words(t):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows = {tuple(w[i:i + min(10, len(w))]) for x in items if (w := words(x)) for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(x) for x in windows}
    return {(i, t) for i, t in docs if not any(tuple(w[a:a + k]) in windows for w in [words(t)] for k in sizes for a in range(len(w) - k + 1))}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    vocabulary = Vocabulary.load()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        path = f"{tmp_path}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        if k == 4:
            got = {r.doc_id: r for r in after.collect()}
            assert len(got) == len(before)
            for i, t in before:
                ids = vocabulary.encode([t])[0]
                assert vocabulary.decode(ids) == t and got[i].n_pieces == len(ids) // 4 and got[i].round_trip
            break
        assert after.columns == columns, name
        got = {(r.doc_id, r.text) for r in after.collect()}
        if k == 0:
            judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
            assert got == {(r.doc_id, r.text) for r in judged if r.kept}
            assert got <= set(before) and len(got) > 0.7 * sum(len((t or "").split()) >= 50 for _, t in before)
        else:
            want = (brute_lines, brute_near, lambda d: brute_clean(d, items))[k - 1](before)
            assert got == want, name
        docs = after
    assert corpus_pipeline.run(spark, sf_dir).count() == len(before)


def test_stages_on_odd_input(spark, edge_dir):
    docs = spark.createDataFrame([(None, "a b c d e", None, None, None), (None, "a b c d e", None, None, None), (1, None, "en", "s", 3), (1, None, "en", "s", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), edge_dir).isEmpty()
        assert stage(spark, docs, edge_dir).count() == (0, 4, 2, 4, 4)[k]
