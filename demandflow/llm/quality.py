"""Operator 9: quality rules whose cutoffs are risk-controlled.

Every rule compares one ratio of a document with a cutoff.  Cutoffs are chosen per stratum from a
labelled holdout: for each cutoff of a fixed grid, the number k of rejected good documents among n gives
the exact binomial p-value P(Bin(n, alpha / rules) <= k) of the hypothesis "this cutoff rejects more than
alpha / rules of the stratum's good documents".  Cutoffs are tested from the safest on (fixed sequence),
each (stratum, rule) at level delta / (strata * rules) (Bonferroni).  So with probability 1 - delta, in every
stratum all rules together reject at most ``alpha`` of the good documents.  Among the certified cutoffs the
one that separates bad from good best is taken; a rule without a certified cutoff that helps is off.

Only DataFrame functions are used.  Signals are computed in one narrow pass without any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandflow.llm.common import save, table

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
ALPHA, DELTA = 0.05, 0.05
#: Each rule: a ratio of signals; a document is rejected where it is above the cutoff
RULES = ("symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word", "long_words")
#: When cutoffs are compared, a rejected share of good documents weighs this many times one of bad documents
CAUTION = 20
#: Cutoffs tried, from the safest (a rule that fires last) on
STEPS = 50


def _count(text: Column, chars: str) -> Column:
    """How often the (ASCII) characters stand in the text."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("long")


def signals(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks (longs).

    Null and empty texts: all 0.  Words in a 3-word window that stands twice or more in the text are counted by
    sorting the window hashes of each text with their places: neighbours with equal hashes are
    repeats.  A text whose windows are all distinct needs no sort.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"}
    docs = docs.drop(*[c for c in docs.columns if c in made])
    text = F.coalesce("text", F.lit(""))
    spaced = text
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    d = docs.withColumn("_spaced", F.btrim(spaced, F.lit(" ")))
    one = F.split("_spaced", " ")  # a literal separator: much faster than a pattern
    d = d.withColumns({
        "_words": F.when(F.col("_spaced") == "", F.array().cast("array<string>"))
                   .when(F.contains("_spaced", F.lit("  ")), F.filter(one, lambda w: w != "")).otherwise(one),
        "_lines": F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""),
    })
    n = F.size("_words")
    d = d.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length("_spaced").cast("long") - _count(F.col("_spaced"), " "),
        "n_symbols": _count(text, "#*$%&|<>"), "n_marks": _count(text, "!?"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    h = F.col("_h")
    # the windows that run beyond the text's end hash nulls and are cut off
    tri = F.transform("_h", lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    d = d.withColumn("_tri", F.slice(tri, 1, F.greatest(n - 2, F.lit(0))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_tri")) < F.size("_tri"),
                                       F.sort_array(F.transform("_tri", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    s = F.col("_sorted")
    same = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    d = d.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: F.isnotnull(x))))))
    at = F.col("_at")
    # each start covers 3 words, or as many as lie before the next start
    gaps = F.transform(at, lambda a, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - a, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.coalesce(
        F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g.cast("long")), F.lit(0).cast("long")))
    return d.drop("_spaced", "_words", "_h", "_lines", "_tri", "_sorted", "_at")


def ratios() -> dict[str, Column]:
    """Every rule's ratio, 0 where it has no base."""
    def per(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"), "upper_share": per("n_upper", "word_chars"),
            "marks_per_word": per("n_marks", "n_words"), "long_words": per("word_chars", "n_words") / 40.0}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _lgamma(x: Column) -> Column:
    """ln gamma(x), x >= 1: Stirling's series at x + 8."""
    y = x + 8.0
    out = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    for i in range(8):
        out = out - F.ln(x + float(i))
    return out


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exact to rounding; 1 where k >= n * p (no cutoff passes there).

    Below the mode the terms fall at least geometrically: the sum runs over all of them, or over so many
    that a geometric bound on the rest, which is added, is negligible.
    """
    k, n = k.cast("double"), n.cast("double")
    log_pmf = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    odds = (1 - p) / p
    many = F.least(k, 200 + 20 * F.sqrt(n * p)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"), k.alias("i"))

    def step(s, _):
        term = s["term"] * s["i"] / (n - s["i"] + 1) * odds
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"), (s["i"] - 1).alias("i"))

    s = F.aggregate(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), start, step,
                    lambda s: s["total"] + F.when(s["i"] > 0, s["term"] * s["i"] / (n * p - s["i"])).otherwise(0.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(log_pmf) * s))


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoffs.

    scored: doc_id, the stratum column and the rules' ratios; labels: doc_id, quality (1 good, 0 bad).
    Null labels and doc_ids with contradicting labels are not used.  All labelled rows count.
    """
    good = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("quality"), F.max("quality").alias("_hi")).where("quality = _hi").drop("_hi"))
    melted = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES]))
    # grid place of a value: cutoff c = step / STEPS rejects v > c, that is, all steps below ceil(v * STEPS)
    counts = (scored.join(good, "doc_id").select(F.col(stratum).alias("stratum"), "quality", melted.alias("m"))
              .select("stratum", "m.rule", "quality", F.least(F.ceil(F.col("m.v") * STEPS), F.lit(STEPS)).cast("int").alias("place"))
              .groupBy("stratum", "rule", "place").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
                                                       F.sum(F.when(F.col("quality") != 1, 1).otherwise(0)).alias("bad")))
    # at most strata * rules * (STEPS + 1) rows from here on
    by_rule = (counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
                                                     F.collect_list(F.struct("place", "good", "bad")).alias("cells"))
               .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))))

    def above(field):
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, x: t + F.when(x["place"] > F.col("step"), x[field]).otherwise(0).cast("long"))

    tests = by_rule.select("stratum", "rule", "step", "n_good", "n_bad", above("good").alias("k_good"), above("bad").alias("k_bad"))
    n_strata = counts.agg(F.count_distinct(F.struct("stratum")).alias("strata"))  # one row
    tests = tests.crossJoin(F.broadcast(n_strata)).withColumn("p", binomial_tail(F.col("k_good"), F.col("n_good"), alpha / len(RULES)))
    gain = F.col("k_bad") / F.greatest("n_bad", F.lit(1)) - CAUTION * F.col("k_good") / F.greatest("n_good", F.lit(1))
    # k_good falls with the cutoff, so that the p-values are monotone: a cutoff that passes alone also
    # passes in the fixed sequence from the safest on
    return (tests.where(F.col("p") <= delta / len(RULES) / F.col("strata")).withColumn("gain", gain).where("gain > 0")
            .groupBy("stratum", "rule").agg(F.max_by("step", F.struct("gain", "step")).alias("step"))
            .select("stratum", "rule", (F.col("step") / STEPS).alias("cutoff")))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA,
          with_text: bool = True) -> DataFrame:
    """docs plus signals, ratios, base_failed, n_rules_failed and kept.

    docs: doc_id, text, the stratum column and any others.  kept is false where base_failed (fewer than
    50 words, or over half of the words in repeated 3-word windows) or where a certified rule rejects.
    Without ``with_text`` the text is not carried on.
    A null stratum is a stratum of its own.  Null text: no words, so rejected.  Without labels only the base
    rules hold.  Equal rows get equal results; no rows: no rows.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks",
            "base_failed", "n_rules_failed", "kept", *RULES}
    docs = docs.drop(*[c for c in docs.columns if c in made])
    scored = signals(docs).withColumns(ratios()).withColumn("base_failed", base_failed())
    scored = save(scored if with_text else scored.drop("text"), "signals")
    cuts = save(cutoffs(scored, labels, stratum, alpha, delta).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES]), "cutoffs")
    fails = sum((F.coalesce(F.col(r) > F.col(f"_cut_{r}"), F.lit(False)).cast("int") for r in RULES), F.lit(0))
    out = scored.join(cuts, scored[stratum].eqNullSafe(cuts["stratum"]), "left").withColumn("n_rules_failed", fails)
    return (out.withColumn("kept", ~F.col("base_failed") & (F.col("n_rules_failed") == 0))
            .select(*[scored[c] for c in scored.columns], "n_rules_failed", "kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document, cutoffs certified on the labelled documents per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    j = judge(docs, table(spark, sf_dir, "labels"), with_text=False)
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_rules_failed")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE: dict = {}
