import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, words=400):
    vocabulary = [f"w{i}" for i in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def edge_texts():
    """Hand-made and random texts: copies, near copies, shared passages and lines, odd characters, very long ones."""
    r = random.Random(7)
    base, passage = prose(r, 200), prose(r, 60)
    near = base.split()
    near[5], near[150] = "changed", "other"
    half = base.split()
    half[::9] = ["z"] * len(half[::9])
    line = "This line stands in many documents."
    texts = [
        base, base, " ".join(near), base.upper(), " ".join(half), "", " \t\n\x0b ", "one", "two words", "a b c d", "A b C d e",
        prose(r, 40) + " " + passage + " " + prose(r, 50), passage + " " + prose(r, 30), prose(r, 30) + "\n" + passage,
        "same same " * 300, prose(r, 80) + "\n" + line + "\n" + prose(r, 60), "  " + line.lower() + "\t\n" + prose(r, 55),
        line + "\n" + line + "\nshort\nshort\n", "\n\n\n", "é ß Ünïcode   text here İstanbul 漢字 😀 ▁ mark", "x" * 5000,
        prose(r, 30000, 5000), prose(r, 60) + "\r\nAPACHE License, cc-by 4.0 and MIT license under the GNU General Public License",
        "write to a.b@c-d.org or +1 (213) 555-2625, 4111 1111 1111 1111, 10.0.0.255 and 300.1.1.1; " + prose(r, 20),
        "the quick brown fox jumps over the lazy dog again and again until night falls", "\u0000 nul \u0000", "'\"\\ quotes #*$%&|<>",
        prose(r, 70) + " the quick brown fox jumps over the lazy dog again and " + prose(r, 70),
    ]
    return texts + [prose(r, r.randrange(1, 120), 30) for _ in range(40)]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """A folder with documents, benchmark and labels made of the edge texts, with ids and without nulls in them."""
    d = str(tmp_path_factory.mktemp("edge"))
    rows = [(i * 3, t, ("en", "de", None)[i % 3], f"s{i % 2}", len(t)) for i, t in enumerate(edge_texts())]
    rows.append((1000, None, None, None, None))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "one"), (3, "Two Words"), (4, ""), (5, None),
             (6, "w1 w2"), (7, "again and again until night"), (10, "the quick brown fox jumps over the lazy dog again")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    labels = [(r[0], i % 4 and 1, 0) for i, r in enumerate(rows)] + [(0, None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, repeated rows, and extra columns whose names clash with results."""
    rows = [(None, "a b c d e f", 1, "x"), (None, "a b c d e f", 1, "x"), (None, None, 2, None), (5, None, 3, "y"), (5, "a b c d e f", 4, "y"),
            (5, "a b c d e f", 4, "y"), (5, "other words in this one", 4, "y"), (6, "", None, None), (7, "This is a line\nThis is a line\nok", 0, "z"),
            (8, "this is a line", 0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, kept long, score string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
