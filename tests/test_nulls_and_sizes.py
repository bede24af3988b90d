"""Results do not change with the size of the data or with null keys; verdicts on hand-made data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandflow.operators import encoders as enc
from demandflow.operators import features as feat
from demandflow.operators import forecast as fc
from demandflow.operators import importance as imp
from demandflow.operators import lookup, order
from demandflow.operators import profile as pr
from demandflow.operators import splits as sp
from demandflow.plans import QUERIES
from demandflow.plans.common import obs_t, ref_of, tgt_of
from demandflow.sources.observations import lookup_samples, observations


@pytest.fixture(params=["small", "bucketed"])
def plan(request, spark):
    """Both plans of the position operator."""
    if request.param == "bucketed":
        spark.conf.set("demandflow.order.smallDistinct", "10")
        spark.conf.set("demandflow.order.positionChunk", "97")
    yield request.param
    spark.conf.unset("demandflow.order.smallDistinct")
    spark.conf.unset("demandflow.order.positionChunk")


def test_rows_without_stratum_keep_their_fold(spark):
    rows = [(i, None if i % 10 == 0 else f"s{i % 3}") for i in range(100)]
    got = sp.stratified_folds(spark.createDataFrame(rows, "i long, s string"), "s", "i").collect()
    assert len(got) == 100
    per = pd.DataFrame([(r.s or "none", r.fold) for r in got], columns=["s", "fold"]).value_counts().unstack(fill_value=0)
    assert ((per.max(axis=1) - per.min(axis=1)) <= 1).all()


def test_bins_equal_pandas_in_both_plans(spark, plan):
    r = np.random.default_rng(8)
    for v in (r.uniform(0, 1, 351), r.integers(0, 40, 300) / 7.0, np.round(r.normal(size=200), 1)):
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(9999, None)], "i long, x double")
        got = {x.i: x.bin for x in order.quantile_bins(df, "x", 10).collect()}
        want = pd.qcut(pd.Series(v), 10, labels=False, duplicates="drop")
        assert got.pop(9999) is None and got == dict(enumerate(want))


def test_quantiles_keep_the_null_group(spark, plan):
    rows = [(None if i % 4 == 0 else "a", float((i * 37) % 101)) for i in range(200)]
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    got = {(r.g, r.q_index): r.x for r in order.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", [0.25, 0.9], by=["g"]).collect()}
    want = pdf.groupby("g", dropna=False).x.quantile([0.25, 0.9])
    assert len(got) == 4
    for (g, i), x in got.items():
        sub = pdf[pdf.g.isna()] if g is None else pdf[pdf.g == g]
        assert x == pytest.approx(sub.x.quantile([0.25, 0.9][i]), rel=1e-12)
    assert len(want) == 4
    ranks = order.average_rank(spark.createDataFrame(rows, "g string, x double"), "x", by=["g"])
    assert ranks.where("rank is null").isEmpty()


def test_null_rank_maps_to_null(spark, plan):
    sample = spark.createDataFrame([(float(i),) for i in range(50)], "y double")
    q = spark.createDataFrame([(0, 0.5), (1, None), (2, -1.0), (3, 2.0)], "i long, r double")
    got = {r.i: r.m for r in order.quantile_map(q, "r", sample, "y", "m").collect()}
    assert got == {0: 24.5, 1: None, 2: 0.0, 3: 49.0}


def test_duplicate_keys_with_nulls(spark):
    rows = [(1, None, "x"), (2, None, "x"), (3, "a", None), (4, "a", "x"), (5, "a", "x")]
    d = pr.duplicate_keys(spark.createDataFrame(rows, "i long, k string, l string"), ["k", "l"])
    want = pd.DataFrame(rows, columns=["i", "k", "l"])
    assert sorted(r.i for r in d.collect()) == want[want.duplicated(["k", "l"], keep=False)].i.tolist()


def test_null_in_a_constant_column_has_no_bin(spark):
    d = feat.equal_width_bins(spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "i long, x double"), "x", {"b": 5})
    assert {r.i: r.b for r in d.collect()} == {1: 2, 2: 2, 3: None}


def test_unlisted_levels_count_as_other(spark):
    rows = [("g", "Sunny"), ("g", "Foggy"), ("g", None), ("g", "Foggy")]
    r = enc.fit_level_mix(spark.createDataFrame(rows, "geohash string, weather string"), "geohash", "weather").first()
    assert (r.geo_weather_0, r.geo_weather_other) == (0.25, 0.5)


def test_tiers_with_null_keys_and_unseen_ones(spark):
    train = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), (None, "x", 9.0), ("b", None, 5.0)], "g string, r string, v double")
    test = spark.createDataFrame([(1, "a", "x"), (2, "a", "q"), (3, "c", "x"), (4, None, "x"), (5, "b", None)], "i long, g string, r string")
    got = {r.i: (r.pred, r.tier) for r in lookup.tiered_lookup(train, test, [["g", "r"], ["g"]], "v").collect()}
    assert got == {1: (1.0, 1), 2: (2.0, 2), 3: (4.5, 3), 4: (4.5, 3), 5: (5.0, 2)}


def test_eta_squared_is_r2_of_group_means(spark):
    r = np.random.default_rng(2)
    rows = [(f"g{i % 4}", float(i % 4 + r.normal()), i) for i in range(200)] + [(None, 50.0, 300), ("g1", None, 301)]
    pdf = pd.DataFrame(rows, columns=["g", "y", "i"]).dropna()
    fit = pdf.groupby("g").y.transform("mean")
    want = 1 - ((pdf.y - fit) ** 2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum()
    got = imp.eta_squared(spark.createDataFrame(rows, "g string, y double, i long"), "g", "y").first()
    assert got.eta2 == pytest.approx(want, rel=1e-9)


class Doubler:
    """A model whose prediction is 2 a, whatever the other columns hold."""

    def transform(self, df):
        return df.withColumn("prediction", 2 * F.col("a"))


def test_permutation_importance_in_points(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), 2.0 * (i % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, a double, c double, y double")
    got = {r.feature: r for r in imp.permutation_importance(Doubler(), df, ["a", "c"], "y", "i", repeats=3).collect()}
    # an independent permutation leaves R^2 near -1: a drop of about 200 points
    assert 150 < got["a"].importance_mean < 250 and got["c"].importance_mean == pytest.approx(0.0, abs=1e-9)
    clipped = {r.feature: r.importance_mean for r in imp.permutation_importance(
        Doubler(), df, ["a"], "y", "i", repeats=1, points_of=lambda p: F.least(F.col(p), F.lit(10.0))).collect()}
    assert clipped["a"] != got["a"].importance_mean


def test_forecast_rows_are_not_trained_on(spark, sf_dir):
    o = obs_t(spark, sf_dir)
    labelled, unlabelled = lookup_samples(tgt_of(o))
    assert labelled.select("idx").intersect(unlabelled.select("idx")).isEmpty()
    ahead = fc.ts_features(unlabelled, fc.fit_templates(ref_of(o), labelled))
    got = {r.idx for r in QUERIES["ts_forecast"](spark, sf_dir).collect()}
    assert got == {r.idx for r in ahead.select("idx").collect()} == {r.idx for r in unlabelled.select("idx").collect()}


def test_final_predictions_cover_every_unlabelled_row(spark, sf_dir):
    want = {r.idx for r in observations(spark, sf_dir).where("idx % 5 = 0").select("idx").collect()}
    assert {r.idx for r in QUERIES["final_predictions"](spark, sf_dir).collect()} == want


def test_validation_gap_and_clusters(spark, sf_dir):
    g = QUERIES["validation_gap"](spark, sf_dir).first()
    assert g.gap == pytest.approx(g.cv_r2 - g.holdout_r2) and g.leaky == int(g.gap > 0.02)
    pdf = QUERIES["spatial_clusters"](spark, sf_dir).toPandas()
    rows = ref_of(observations(spark, sf_dir)).groupBy("geohash").count().toPandas()
    both = pdf.merge(rows, on="geohash")
    centre = both.groupby("cluster").apply(lambda x: pd.Series({"a": np.average(x.lat, weights=x["count"]), "o": np.average(x.lon, weights=x["count"])}))
    d = (both.lat.values[:, None] - centre.a.values) ** 2 + (both.lon.values[:, None] - centre.o.values) ** 2
    near = centre.index.values[d.argmin(axis=1)]
    assert (near == both.cluster.values).mean() > 0.95  # weighted centres are the assigned ones, but for a last step


def test_adversarial_has_two_classifiers_and_no_fitted_columns(spark, sf_dir):
    rows = QUERIES["adversarial_auc"](spark, sf_dir).collect()
    assert {r.classifier for r in rows} == {"gbt", "forest"}
    assert not {r.feature for r in rows} & {"te_geohash", "geohash_count"}
    assert all(0 <= r.auc <= 1 for r in rows)


def test_coverage_of_several_key_sets(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", None), (None, 3)], "g string, t long")
    b = spark.createDataFrame([("x", 1), ("z", 3), ("z", 3), (None, None)], "g string, t long")
    got = {r.key: (r.n_a, r.n_b, r.n_shared, r.n_unseen_in_b) for r in sp.coverage_report(a, b, {"g": ["g"], "t": ["t"], "g+t": ["g", "t"]}).collect()}
    assert got == {"g": (2, 2, 1, 1), "t": (3, 2, 2, 0), "g+t": (2, 2, 1, 1)}
