"""V7: the leakage audit of samples that one table is split into, from one melted aggregate.

Every row carries the samples it belongs to as flags.  It is melted to one entry per key set (the key's columns) and one per
category column (its level); one aggregate with a count per sample then holds, for every distinct key, which samples
have it (the counts above zero are the key's membership bitmap) and how often.  Key overlaps, level shares and repeated keys are all
small aggregates of that table, which is written once; the rows themselves are read once and never joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandflow.session import materialize

#: Shares of shared keys (percent) from which an overlap is high; of a level (points) from which two samples differ
HIGH_OVERLAP, SHIFT = 10.0, 5.0
COLUMNS = "part string, comparison string, item string, level string, n_a long, n_b long, n_shared long, pct_a double, pct_b double, verdict string"


def melted_counts(df: DataFrame, samples: dict[str, Column], key_sets: dict[str, list[str]], categories: list[str]) -> DataFrame:
    """kind ('key' or 'level'), item, the key columns, level, and a count per sample: one pass, combined before its shuffle.
    Keys and levels with a missing part are left out."""
    kinds = dict(df.dtypes)
    parts = list(dict.fromkeys(c for keys in key_sets.values() for c in keys))

    def entry(kind, item, keys, level):
        known = F.lit(True)
        for c in [*keys, *([level] if level else [])]:
            known = known & F.col(c).isNotNull()
        return F.when(known, F.struct(F.lit(kind).alias("kind"), F.lit(item).alias("item"),
                                      *[(F.col(c) if c in keys else F.lit(None)).cast(kinds[c]).alias(c) for c in parts],
                                      (F.col(level).cast("string") if level else F.lit(None).cast("string")).alias("level")))

    entries = [entry("key", name, keys, None) for name, keys in key_sets.items()] + [entry("level", c, [], c) for c in categories]
    flags = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"), *[c.alias(s) for s, c in samples.items()])
    return flags.select("e.*", *samples).groupBy("kind", "item", *parts, "level").agg(*[F.count_if(F.col(s)).alias(s) for s in samples])


def leakage_audit(df: DataFrame, samples: dict[str, Column], comparisons: dict[str, tuple[str, str]], key_sets: dict[str, list[str]],
                  categories: list[str], repeated: tuple[str, str], high: float = HIGH_OVERLAP, shift: float = SHIFT) -> DataFrame:
    """Rows of four parts.

    ``overlap``: per comparison (sample a, sample b) and key set the distinct keys of a, of b, shared ones, the share of b's keys in a and the
    share of b's not in a.  ``share``: per comparison and category level the rows of a and b and their percentages.  ``repeated``: rows
    of the sample ``repeated[0]`` whose key of the set ``repeated[1]`` stands more than once (n_a), such keys (n_b), and their percentages of
    its rows and keys.  ``verdict``: per key set whether folds share keys that the real test sample does not (``folds_leak``), both do
    (``known_keys``) or the folds do not (``safe``); the first comparison is that of the folds, the last that of the real test sample."""
    counts = materialize(melted_counts(df, samples, key_sets, categories), "leakage")
    spark = df.sparkSession
    keys, levels = counts.where("kind = 'key'"), counts.where("kind = 'level'")
    null = F.lit(None)
    names = spark.createDataFrame([(k,) for k in key_sets], "item string")
    out, overlaps = [], {}
    for name, (a, b) in comparisons.items():
        o = keys.groupBy("item").agg(F.count_if(F.col(a) > 0).alias("n_a"), F.count_if(F.col(b) > 0).alias("n_b"), F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias("n_shared"))
        o = names.join(o, "item", "left").na.fill(0)
        pct = F.when(F.col("n_b") > 0, F.col("n_shared") * 100.0 / F.col("n_b"))
        o = o.withColumns({"pct_a": pct, "pct_b": F.when(F.col("n_b") > 0, (F.col("n_b") - F.col("n_shared")) * 100.0 / F.col("n_b"))})
        overlaps[name] = o
        out.append(o.select(F.lit("overlap").alias("part"), F.lit(name).alias("comparison"), "item", null.cast("string").alias("level"), "n_a", "n_b", "n_shared", "pct_a", "pct_b",
                            F.when(F.col("pct_a") >= high, "high_overlap").otherwise("low_overlap").alias("verdict")))
        totals = levels.groupBy("item").agg(F.sum(a).alias("_ta"), F.sum(b).alias("_tb"))  # one row per category column
        s = levels.join(F.broadcast(totals), "item").where((F.col(a) > 0) | (F.col(b) > 0))
        pa, pb = (F.when(F.col(t) > 0, F.col(c) * 100.0 / F.col(t)) for c, t in ((a, "_ta"), (b, "_tb")))
        out.append(s.select(F.lit("share").alias("part"), F.lit(name).alias("comparison"), "item", "level", F.col(a).alias("n_a"), F.col(b).alias("n_b"),
                            F.least(a, b).alias("n_shared"), pa.alias("pct_a"), pb.alias("pct_b"), F.when(F.abs(pa - pb) > shift, "shifted").otherwise("alike").alias("verdict")))
    sample, key_set = repeated
    many = F.col(sample) > 1
    r = keys.where((F.col("item") == key_set) & (F.col(sample) > 0)).agg(
        F.coalesce(F.sum(F.when(many, F.col(sample))), F.lit(0)).alias("n_a"), F.count_if(many).alias("n_b"), F.coalesce(F.sum(sample), F.lit(0)).alias("_rows"), F.count(F.lit(1)).alias("_keys"))
    out.append(r.select(F.lit("repeated").alias("part"), F.lit(sample).alias("comparison"), F.lit(key_set).alias("item"), null.cast("string").alias("level"), "n_a", "n_b",
                        F.lit(0).cast("long").alias("n_shared"), F.when(F.col("_rows") > 0, F.col("n_a") * 100.0 / F.col("_rows")).alias("pct_a"),
                        F.when(F.col("_keys") > 0, F.col("n_b") * 100.0 / F.col("_keys")).alias("pct_b"), F.when(F.col("n_a") > 0, "repeated").otherwise("unique").alias("verdict")))
    first, last = list(comparisons)[0], list(comparisons)[-1]
    both = overlaps[first].select("item", F.col("pct_a").alias("_folds")).join(overlaps[last].select("item", F.col("pct_a").alias("_test")), "item")
    verdict = F.when(F.coalesce(F.col("_folds"), F.lit(0.0)) < high, "safe").when(F.coalesce(F.col("_test"), F.lit(0.0)) < high, "folds_leak").otherwise("known_keys")
    n = null.cast("long")
    out.append(both.select(F.lit("verdict").alias("part"), F.lit(f"{first}/{last}").alias("comparison"), "item", null.cast("string").alias("level"), n.alias("n_a"), n.alias("n_b"),
                           n.alias("n_shared"), F.col("_folds").alias("pct_a"), F.col("_test").alias("pct_b"), verdict.alias("verdict")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole
