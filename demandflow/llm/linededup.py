"""Operator 8: line dedup with levelled sorted runs of line hashes.

Documents come in batches of rising doc_id.  The keys seen so far live in *runs*: tables of
(hash, first owner), bucketed and sorted by hash, so that a merge join with a run moves only the new
batch.  Each batch is reduced to its distinct keys, merge-joined with every run (found: an earlier
document owns the line; not found: new), and adds its new keys as a run of level 0.  When a level has
``fanout`` runs, they are compacted into one run of the next level.

Only DataFrame functions are used.  Line texts are never shuffled, only their 128-bit hashes;
each key is pre-aggregated before its shuffle, and the join of lines with keys is a plain shuffled
join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from demandflow.llm.common import ascii_lower, row_key, save, scratch_path, table

SPACE_CHARS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
#: Ids that the bounds of the batches are taken of, where ids are not numbers
BOUND_IDS = 4000
#: Distinct keys of a run that one bucket should hold
KEYS_PER_BUCKET = 1_000_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


class LineRuns:
    """The runs: ``classify`` a batch's keys against all of them, which also adds the new ones."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", scratch_path(self.spark, name)).saveAsTable(name))
        self.tables.append(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("is_new").select("h1", "h2", F.col("owner").alias("earlier"))

    def classify(self, keys: DataFrame) -> DataFrame:
        """keys: (h1, h2, owner, many).  Returns (h1, h2, owner, many, is_new) with the first owner of
        all batches so far; keys that no run holds are added as a run."""
        out = keys.withColumn("is_new", F.lit(True))
        for level in self.levels:
            for name in level:
                out = (out.join(self._run(name), ["h1", "h2"], "left")
                       .select("h1", "h2", F.coalesce("earlier", "owner").alias("owner"), "many",
                               (F.col("is_new") & F.isnull("earlier")).alias("is_new")))
        name = self._write(out)
        self._add(name, 0)
        return self.spark.table(name)

    def _add(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged = None
            for x in self.levels[level]:
                one = self.spark.table(x).where("is_new")
                merged = one if merged is None else merged.unionByName(one)
            self.levels[level] = []
            self._add(self._write(merged), level + 1)

    def close(self) -> None:
        """Forget the runs' tables (their files stay until the shared folder is cleaned)."""
        for x in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")
        self.tables = []


def batch_bounds(docs: DataFrame, batches: int) -> list:
    """Ids that part the documents into batches of about equal size, rising; ids of any type that has an order.  The bounds only tell
    how large batches are, never a result."""
    shares = [i / batches for i in range(1, batches)]
    ids = docs.where("doc_id is not null").select("doc_id")
    if not shares:
        return []
    if isinstance(docs.schema["doc_id"].dataType, NumericType):
        return sorted(set(ids.approxQuantile("doc_id", shares, 0.01)))
    n = ids.count()
    bound = min(2**63 - 1, -(2**63) + int(min(1.0, BOUND_IDS / max(n, 1)) * 2**64))
    some = [r.doc_id for r in ids.where(F.xxhash64("doc_id") <= F.lit(bound)).orderBy("doc_id").limit(2 * BOUND_IDS).collect()]
    return list(dict.fromkeys(some[int(s * len(some))] for s in shares)) if some else []


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                  fanout: int = FANOUT) -> DataFrame:
    """(_k1, _k2, pos): the lines to drop, by row key and place."""
    spark = docs.sparkSession
    cuts = batch_bounds(docs, batches)
    batch = F.lit(0)
    for c in cuts:  # ids without a value come last
        batch = batch + F.when(F.isnull("doc_id") | (F.col("doc_id") > F.lit(c)), 1).otherwise(0)
    lines = (docs.select("doc_id", *row_key("doc_id", "text"), batch.alias("batch"), F.posexplode(F.split("text", "\n", -1)))
             .withColumn("key", line_key(F.col("col"))).where(F.length("key") >= min_chars)
             .select("batch", "_k1", "_k2", "pos", F.struct(F.isnull("doc_id").alias("n"), F.col("doc_id").alias("id")).alias("owner"),
                     F.xxhash64(F.lit(1), F.col("key")).alias("h1"), F.xxhash64(F.lit(2), F.col("key")).alias("h2")))
    lines = save(lines, "lines", "batch")
    n = lines.count()
    runs = LineRuns(spark, max(1, -(-n // KEYS_PER_BUCKET)), fanout)
    drops = None
    for b in range(len(cuts) + 1):
        mine = lines.where(F.col("batch") == b).drop("batch")
        keys = mine.groupBy("h1", "h2").agg(F.min("owner").alias("owner"),
                                            (~F.min("owner").eqNullSafe(F.max("owner"))).alias("many"))
        taken = (runs.classify(keys).where(F.col("many") | ~F.col("is_new"))
                 .select("h1", "h2", F.col("owner").alias("first")))
        one = (mine.join(taken, ["h1", "h2"]).where(~F.col("owner").eqNullSafe(F.col("first")))
               .select("_k1", "_k2", "pos"))
        drops = one if drops is None else drops.unionByName(one)
    drops = save(drops, "drops")
    runs.close()
    return drops


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                fanout: int = FANOUT) -> DataFrame:
    """Drop repeated lines everywhere but in the document with the smallest doc_id.

    docs: doc_id, text and any other columns, which are kept.  Adds kept_text, n_lines, n_dropped.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys of fewer than
    ``min_chars`` code points never count.  Null or empty text: one empty line, kept_text ''.  Rows of
    one doc_id are one document: a line that they share stays in all of them.  Rows without doc_id are
    one document that comes after all others.  Ids may be of any type that has an order.  Equal rows get equal results.
    No rows: no rows.  ``batches`` does not grow with the documents: it is how often the runs are merged, not how large a
    task is.
    """
    own = set(docs.columns)
    if clash := own & {"kept_text", "n_lines", "n_dropped", "_k1", "_k2", "_drop", "_lines"}:
        docs = docs.drop(*clash)
    drops = (dropped_lines(docs, min_chars, batches, fanout).distinct()
             .groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list("pos")).alias("_drop")))
    lines = docs.withColumns({c: v for c, v in zip(("_k1", "_k2"), row_key("doc_id", "text"), strict=True)})
    out = lines.join(drops, ["_k1", "_k2"], "left").withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    out = out.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.when(F.isnull("_drop"), 0).otherwise(F.size("_drop")).cast("long"),
        "_kept": F.when(F.isnull("_drop"), F.col("_lines")).otherwise(
            F.transform(places, lambda i: F.get(F.col("_lines"), i)))})
    out = out.withColumn("kept_text", F.array_join("_kept", "\n"))
    return out.select(*[c for c in docs.columns if c not in ("_k1", "_k2")], "kept_text", "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = f"""WITH l AS (
  SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS key FROM l),
d AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, d.key IS NOT NULL AND k.doc_id <> d.first AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""

QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE = {"op8_line_dedup": OP8_SQL}
