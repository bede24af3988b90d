"""Early stopping by patience, the fit plan, the search with its store, ordered target statistics: against plain loops."""

import hashlib
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from demandflow.operators import fits, native, search
from demandflow.operators.crosses import pair_gains
from demandflow.operators.encoders import observed_level_mix
from demandflow.operators.extra_trees import ExtraTrees
from demandflow.operators.leakage import leakage_audit
from demandflow.operators.lookup import tiered_lookup
from demandflow.operators.quantiles import quantile_numbers
from demandflow.plans.catalog.tuning import deal_by_softmax, seven_approaches

PARAMS = dict(maxIter=24, maxDepth=3, stepSize=0.3, seed=7)


@pytest.fixture(scope="module")
def frame(spark, tmp_path_factory):
    r = random.Random(1)
    rows = []
    for i in range(400):
        a, b = r.random(), r.random()
        rows.append((i, a, b, float(a > 0.5) + 0.5 * b + r.gauss(0, 0.6), i % 4))
    path = str(tmp_path_factory.mktemp("fits") / "frame")
    spark.createDataFrame(rows, "idx long, a double, b double, y double, part int").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def prefix_errors(frame, rounds):
    """Mean squared error on part 0 of every prefix of a straight fit, tree by tree; and every prefix's predictions."""
    asm = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    model = GBTRegressor(featuresCol="features", labelCol="y", **{**PARAMS, "maxIter": rounds}).fit(asm.transform(frame.where("part > 0").coalesce(1)))
    valid = asm.transform(frame.where("part = 0")).orderBy("idx")
    y = np.array([r.y for r in valid.collect()])
    total, out, preds = np.zeros(len(y)), [], []
    for tree, w in zip(model.trees, model.treeWeights, strict=True):
        total = total + w * np.array([r.prediction for r in tree.transform(valid).orderBy("idx").collect()])
        out.append(float(((total - y) ** 2).mean()))
        preds.append(total)
    return out, preds


def plain_stop(errors, patience):
    for n in range(1, len(errors) + 1):
        best = min(range(n), key=lambda i: (errors[i], i))
        if n - 1 - best >= patience:
            return best + 1, True
    return min(range(len(errors)), key=lambda i: (errors[i], i)) + 1, False


def test_stopping_round():
    r = random.Random(2)
    for _ in range(300):
        errors = [r.choice([1.0, 0.9, 0.8, 0.7, 0.5]) for _ in range(r.randrange(1, 15))]
        for patience in (1, 2, 5):
            assert fits.stopping_round(errors, patience) == plain_stop(errors, patience)


@pytest.mark.parametrize("patience", [2, 4, 50])
def test_patience_against_all_prefixes(frame, patience):
    errors, preds = prefix_errors(frame, PARAMS["maxIter"])
    want, _ = plain_stop(errors, patience)
    got = fits.fit_with_patience(frame.where("part > 0").coalesce(1), frame.where("part = 0"), ["a", "b"], "y", PARAMS, patience)
    assert got.n_trees == want and got.error == pytest.approx(errors[want - 1])
    assert got.model.stages[-1].getNumTrees == want
    have = [r.prediction for r in got.model.transform(frame.where("part = 0")).orderBy("idx").collect()]
    assert np.allclose(have, preds[want - 1])


def test_plan_does_each_fit_once(spark, frame, monkeypatch):
    calls = []
    plain = fits.fit_with_patience
    monkeypatch.setattr(fits, "fit_with_patience", lambda *a: calls.append(a) or plain(*a))
    name = "plan-" + hashlib.md5(str(random.random()).encode()).hexdigest()
    a = fits.Fit.of("part > 0", ["a", "b"], "y", {**PARAMS, "maxIter": 6}, "part = 0", 2)
    b = fits.Fit.of("part > 1", ["a"], "y", {**PARAMS, "maxIter": 3})
    first = fits.FitPlan(frame, name).run([a, b, a])
    assert len(calls) == 2 and first[0] is first[2] and first[1].n_trees == 3
    # another plan on the same contents (in another order of rows and columns) reads the models back
    again = fits.FitPlan(frame.select("y", "part", "b", "a", "idx").orderBy(F.desc("idx")), name).run([b, a])
    assert len(calls) == 2 and [x.n_trees for x in again] == [3, first[0].n_trees] and again[1].error == first[0].error
    p, q = (sorted((r.idx, r.prediction) for r in m.transform(frame).collect()) for m in (first[0].model, again[1].model))
    assert p == q
    other = fits.FitPlan(frame.withColumn("y", F.col("y") + F.when(F.col("idx") == 3, 1e-9).otherwise(0.0)), name)
    assert other.key(a) != fits.FitPlan(frame, name).key(a)


def small_search(frame, store, **more):
    space = {"maxIter": ("int", 5, 9), "stepSize": ("logfloat", 0.05, 0.5), "maxDepth": ("int", 1, 3)}
    studies = [search.Study.of("one", ["a"], space), search.Study.of("two", ["a", "b"], space)]
    return search.Search(frame, studies, "part > 0", "part = 0", "y", rungs=(2, 4), climb=2, patience=3, store=store, **more)


def test_search_resumes_without_repeating_a_trial(frame, monkeypatch):
    def run(s):
        return s.run(4, lambda e: -e, deal_by_softmax, 5)

    whole = small_search(frame, "trials-whole")
    want = run(whole)
    assert len({(s, t) for s, t, *_ in want}) == len(want) >= 8 + 4  # two parts are cut to whole numbers
    assert all(r[2] == (1 if r[1] < 4 else 2) for r in want)

    class Killed(Exception):
        pass

    killed = small_search(frame, "trials-killed")
    killed.at_a_time = 1
    add, seen = killed.store.add, []

    def dies(*a):
        if len(seen) >= 7:
            raise Killed
        add(*a)
        seen.append(a)

    monkeypatch.setattr(killed.store, "add", dies)
    with pytest.raises(Killed):
        run(killed)
    resumed = small_search(frame, "trials-killed")
    assert run(resumed) == want and resumed.run_trials == whole.run_trials - len(seen) and len(seen) >= 7
    third = small_search(frame, "trials-killed")
    assert run(third) == want and third.run_trials == 0


def test_rungs_stop_poor_trials(frame):
    s = small_search(frame, "trials-rungs")
    rows = s.batches({"two": list(range(8))})
    rung = {r[1]: r[2] for r in rows}
    assert sum(v >= 1 for v in rung.values()) <= 4 and sum(v >= 2 for v in rung.values()) <= 2 and max(rung.values()) >= 1
    first = {r.trial: r.error for r in s.store.table().where("rung = 0 and study = 'two'").collect()}
    order = sorted(first, key=lambda t: (first[t], t))
    assert {t for t, v in rung.items() if v >= 1} <= set(order[:4])
    best = s.best_params([("two", t, 1, g, at, e, -e) for _, t, g, at, e in rows], "two")
    assert best["maxIter"] == min(rows, key=lambda r: (r[4], r[1]))[3]


def test_draws_stay_in_the_reference_ranges():
    for name, space in search.SPACES.items():
        drawn = [search.draw(space, random.Random(f"{name}{i}")) for i in range(300)]
        for k, (kind, lo, hi) in space.items():
            values = [d[k] for d in drawn]
            assert lo <= min(values) and max(values) <= hi and (kind != "int" or all(isinstance(v, int) for v in values))
        assert min(d["maxIter"] for d in drawn) >= 300 and max(d["maxIter"] for d in drawn) > 1000
    assert deal_by_softmax({"a": 1.0, "b": 1.0, "c": -1000.0}, 181) == {"a": 90, "b": 90, "c": 0}


@pytest.mark.parametrize("chunk_rows", [1, 7, 1000])
def test_ordered_statistics(spark, chunk_rows):
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 6 + ["x", "y", None]), r.choice([0.1, 0.25, 1.75, None])) for i in range(120)]
    train = spark.createDataFrame(rows, "idx long, c string, t double")
    got = {x.idx: x.c_ots for x in native.ordered_statistics(train, ["c"], "t", "idx", chunk_rows=chunk_rows).collect()}
    known = [Decimal(str(t)) for _, _, t in rows if t is not None]
    prior = float(sum(known)) / len(known)
    order = sorted(rows, key=lambda x: (hashlib.md5(f"42-{x[0]}".encode()).hexdigest(), x[0]))
    for i, (idx, c, _) in enumerate(order):
        before = [Decimal(str(t)) for _, c2, t in order[:i] if c2 == c and t is not None]
        assert got[idx] == pytest.approx((float(sum(before)) + prior) / (len(before) + 1), abs=1e-12)
    whole = {x.c: x.c_ots for x in native.whole_statistics(spark.createDataFrame([("hot",), ("new",), (None,)], "c string"), train, ["c"], "t").collect()}
    hot = [Decimal(str(t)) for _, c, t in rows if c == "hot" and t is not None]
    assert whole["hot"] == pytest.approx((float(sum(hot)) + prior) / (len(hot) + 1)) and whole["new"] == pytest.approx(prior)


def test_ordered_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "idx long, c string, t double")
    assert native.ordered_statistics(empty, ["c"], "t", "idx").collect() == []


def test_lookup_sums_are_exact(spark):
    """Means that lie on a half at the seventh decimal do not depend on partitions, tiers or order."""
    r = random.Random(4)
    train = [(r.choice("ab"), r.choice("xyz"), r.choice([1, 2, None]), Decimal(r.randrange(1, 100000)).scaleb(-5)) for _ in range(500)]
    test = [("a", "x", 1), ("a", "new", 1), ("b", "z", None), ("new", "x", 1), (None, "x", 1), ("a", None, 2)]
    tiers = [["d", "g", "t"], ["g", "t"], ["g"]]
    want = {}
    for g, t, d in test:
        for tier, keys in enumerate(tiers, 1):
            own = {"g": g, "t": t, "d": d}
            rows = [v for a, b, c, v in train if all(own[k] is not None and {"g": a, "t": b, "d": c}[k] == own[k] for k in keys)]
            if rows:
                break
        else:
            tier, rows = 4, [v for *_, v in train]
        want[(g, t, d)] = (float(sum(rows)) / len(rows), tier)
    test_df = spark.createDataFrame(test, "g string, t string, d int")
    for n in (1, 3, 16):
        train_df = spark.createDataFrame([(a, b, c, float(v)) for a, b, c, v in train], "g string, t string, d int, v double").repartition(n)
        got = {(x.g, x.t, x.d): (x.pred, x.tier) for x in tiered_lookup(train_df, test_df, tiers, "v").collect()}
        assert got == want


def test_audit_of_empty_samples(spark):
    df = spark.createDataFrame([("a", 1, "r"), ("a", 1, None), (None, 2, "s")], "g string, t int, c string")
    rows = leakage_audit(df, {"x": F.lit(True), "none": F.lit(False)}, {"f": ("x", "none"), "t": ("none", "x")}, {"g": ["g"], "gt": ["g", "t"]}, ["c"], ("x", "gt")).collect()
    by = {(r.part, r.comparison, r.item, r.level): r for r in rows}
    assert by[("overlap", "f", "g", None)].n_a == 1 and by[("overlap", "f", "g", None)].pct_a is None and by[("overlap", "t", "g", None)].pct_a == 0
    assert by[("share", "f", "c", "r")].pct_a == 50 and by[("share", "f", "c", "r")].n_b == 0
    assert (by[("repeated", "x", "gt", None)].n_a, by[("repeated", "x", "gt", None)].n_b) == (2, 1)
    assert by[("verdict", "f/t", "g", None)].verdict == "safe"


def test_pair_gains_find_the_cross(spark):
    r = random.Random(5)
    rows = [(a, b, c, float((a == 1) != (b == 1)) + r.gauss(0, 0.1)) for a, b, c in ((r.randrange(2), r.randrange(2), r.randrange(3)) for _ in range(400))]
    got = {(x.a, x.b): x for x in pair_gains(spark.createDataFrame(rows, "a int, b int, c int, y double"), ["a", "b", "c"], "y").collect()}
    assert got[("a", "b")].gain > 0.9 and got[("a", "c")].gain < 0.1 and got[("b", "c")].cells == 6
    constant = pair_gains(spark.createDataFrame([(1, 2, 3.0)] * 4, "a int, b int, y double"), ["a", "b"], "y").first()
    assert constant.gain is None


def test_level_mix_by_observed_level(spark):
    df = spark.createDataFrame([("g", "a b"), ("g", None), ("h", "c.d"), (None, "e")], "k string, v string")
    got = {r.k: r for r in observed_level_mix(df, "k", "v", "m").collect()}
    assert set(got) == {"g", "h"} and got["g"]["m_a b"] == 0.5 and got["h"]["m_c.d"] == 1.0 and "m_e" not in got["g"].asDict()


def test_seven_approaches(spark):
    r = random.Random(6)
    oof = [(i, y := r.random(), y + r.gauss(0, 0.05), r.random(), 0.5 * y) for i in range(200)]
    oof = spark.createDataFrame([tuple(map(float, x[1:])) + (x[0],) for x in oof], "demand double, a double, b double, c double, idx long")
    test = oof.where("idx < 20").withColumn("demand", F.lit(None).cast("double"))
    scores, preds, own = seven_approaches(oof, test, ["a", "b", "c"])
    by = {x.approach: x for x in scores.collect()}
    assert len(by) == 7 and {"a", "b", "c", "equal", "optimized", "rank"} < set(by) and sum(x.is_best for x in by.values()) == 1
    best = max(by.values(), key=lambda x: x.r2)
    assert best.is_best == 1 and by["optimized"].r2 >= max(by[m].r2 for m in ("a", "b", "c", "equal")) - 1e-9
    assert preds.count() == 20 and preds.where(F.col(best.approach).isNull()).isEmpty()


@pytest.mark.parametrize("limit,accuracy", [(10**6, 20_000), (40, 50), (1, 200)])
def test_quantiles_by_bracket(spark, limit, accuracy):
    """Any width of the brackets gives numpy's quantiles: ties, hot values, missing ones, columns of one value or none."""
    r = np.random.default_rng(8)
    cols = {"even": r.random(700), "ties": r.integers(0, 5, 700).astype(float), "hot": np.where(r.random(700) < 0.9, 3.5, r.random(700)), "one": np.full(700, -2.0),
            "few": np.r_[[0.0, -1.5, 7.0], np.full(697, np.nan)], "none": np.full(700, np.nan), "signed": r.normal(size=700) * 1e9}
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in row) for i, row in enumerate(zip(*cols.values(), strict=True))],
                               ", ".join(f"{c} double" for c in cols)).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.999, 1.0]
    for weights in (False, True):
        got = quantile_numbers(df, {c: probs for c in cols}, weights, limit, accuracy)
        for c, v in cols.items():
            v = v[~np.isnan(v)]
            if len(v):
                assert np.allclose(got[c], np.quantile(v, probs), rtol=1e-12, atol=1e-12), c
            else:
                assert got[c] == [None] * len(probs)


def test_extra_trees_split_at_random_thresholds(frame):
    df = frame.withColumn("c", F.lit(1.0))
    make = lambda seed: ExtraTrees(["a", "b", "c"], "y", n_trees=6, max_depth=4, cuts=5, feature_share="all", seed=seed).fit(df)
    one, same, other = make(1), make(1), make(2)
    assert [t.cuts for t in one.trees] == [t.cuts for t in same.trees] != [t.cuts for t in other.trees]
    assert len({tuple(t.cuts[0]) for t in one.trees}) == 6 and all(t.cuts[2] == [] for t in one.trees)
    rows = one.predict(df).orderBy("idx").collect()
    again = [r.pred for r in same.predict(df).orderBy("idx").collect()]
    assert [r.pred for r in rows] == again
    # each tree is constant between its own cut points, and the forest is the mean of its trees
    singles = []
    for t in one.trees:
        alone = ExtraTrees(["a", "b", "c"], "y")
        alone.trees = [t]
        p = alone.predict(df).orderBy("idx").collect()
        cells = {}
        for r in p:
            cells.setdefault((sum(r.a > x for x in t.cuts[0]), sum(r.b > x for x in t.cuts[1])), set()).add(r.pred)
        assert all(len(v) == 1 for v in cells.values())
        singles.append([r.pred for r in p])
    assert np.allclose(np.mean(singles, axis=0), [r.pred for r in rows])
    y = np.array([r.y for r in rows])
    assert 1 - ((y - [r.pred for r in rows]) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.3
