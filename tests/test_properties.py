"""Property tests: folds, encoders, blends, importance, re-partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandflow.operators import encoders as enc
from demandflow.operators import ensemble as ens
from demandflow.operators import importance as imp
from demandflow.operators import splits as sp
from demandflow.plans import QUERIES
from demandflow.sources.observations import base_predictions, observations


@pytest.fixture(scope="module")
def obs(spark, sf_dir):
    return observations(spark, sf_dir)


def test_stratified_folds_disjoint_balanced_complete(spark, obs):
    f = sp.target_decile_folds(obs, "demand", "idx").select("idx", "fold").toPandas()
    assert len(f) == obs.count() and f.idx.is_unique
    assert set(f.fold) == set(range(5))
    bins = sp.quantile_bins(obs, "demand", 10, "b").select("idx", "b").toPandas()
    m = f.merge(bins, on="idx")
    for _, g in m.groupby("b"):
        c = g.fold.value_counts().reindex(range(5), fill_value=0)
        assert c.max() - c.min() <= 1


def test_rolling_folds_follow_expanding_window_rule(spark, obs):
    ref = obs.where(F.col("day") <= 20).withColumn("slot", F.lit(0))
    n = ref.count()
    got = sp.rolling_folds(ref, ["day", "slot", "idx"], "idx").toPandas()
    order = ref.select("idx", "day").toPandas().sort_values(["day", "idx"]).idx.tolist()
    t = n // 6
    for i in range(5):
        start = n - (5 - i) * t
        g = got[got.fold == i]
        assert sorted(g[g.role == "train"].idx) == sorted(order[:start])
        assert sorted(g[g.role == "valid"].idx) == sorted(order[start:start + t])


def test_encoder_invariant_to_row_order_and_partitioning(spark, obs):
    a = enc.apply_smoothed(obs, enc.fit_smoothed(obs, ["geohash"], "demand"), ["geohash"], "te")
    shuffled = obs.repartition(13, "day").orderBy(F.rand(7))
    b = enc.apply_smoothed(shuffled, enc.fit_smoothed(shuffled, ["geohash"], "demand"), ["geohash"], "te")
    pa = a.select("idx", "te").toPandas().sort_values("idx").reset_index(drop=True)
    pb = b.select("idx", "te").toPandas().sort_values("idx").reset_index(drop=True)
    assert np.allclose(pa.te, pb.te, atol=1e-12)


def test_blend_weights_on_simplex_and_optimal_beats_grid(spark, obs):
    bp = base_predictions(obs)
    grid = ens.blend_grid(bp, "demand", ["pa", "pb", "pc"], steps=21).toPandas()
    best = grid[grid.is_best == 1].iloc[0]
    assert best.r2 == grid.r2.max()
    assert np.allclose(grid[["w_pa", "w_pb", "w_pc"]].sum(axis=1), 1.0)
    opt = ens.blend_optimal(bp, "demand", ["pa", "pb", "pc"])
    w = np.array(list(opt["weights"].values()))
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9
    assert opt["r2"] >= best.r2 - 1e-9
    # the moments R^2 of the grid equals a direct rescan
    p = bp.toPandas()
    blend = best.w_pa * p.pa + best.w_pb * p.pb + best.w_pc * p.pc
    direct = 1 - ((p.demand - blend) ** 2).sum() / ((p.demand - p.demand.mean()) ** 2).sum()
    assert best.r2 == pytest.approx(direct, abs=1e-9)


def test_linear_shapley_equals_closed_form(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"i": range(200), "a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["y"] = 2 * pdf.a - 3 * pdf.b + 0.5
    df = spark.createDataFrame(pdf)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    bg = df.agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    got = dict((r["feature"], r["mean_abs_shap"]) for r in
               imp.shapley_importance(model, df, bg, ["a", "b"], "i", n_perms=3).collect())
    coef = model.stages[-1].coefficients
    assert got["a"] == pytest.approx(abs(coef[0]) * (pdf.a - pdf.a.mean()).abs().mean(), rel=1e-6)
    assert got["b"] == pytest.approx(abs(coef[1]) * (pdf.b - pdf.b.mean()).abs().mean(), rel=1e-6)


def test_permutation_of_constant_feature_is_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"i": range(150), "a": rng.normal(size=150), "c": 1.0})
    pdf["y"] = pdf.a * 3
    df = spark.createDataFrame(pdf)
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "c"], outputCol="features"),
                             LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    got = {r["feature"]: r["importance_mean"] for r in
           imp.permutation_importance(model, df, ["a", "c"], "y", "i", repeats=2).collect()}
    assert got["c"] == pytest.approx(0.0, abs=1e-12) and got["a"] > 0.5


@pytest.mark.parametrize("name", ["tiered_lookup", "te_median", "avg_rank", "stratified_folds"])
def test_same_result_with_1_and_16_shuffle_partitions(spark, sf_dir, name):
    res = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1]


def test_folds_are_dealt_round_robin_in_hash_order(spark, obs):
    df = obs.withColumn("s", F.col("day") % 2)
    rows = sp.stratified_folds(df, "s", "idx").withColumn("h", sp.seeded_hash("idx")).select("s", "h", "idx", "fold").collect()
    for s in (0, 1):
        folds = [r.fold for r in sorted((r for r in rows if r.s == s), key=lambda r: (r.h, r.idx))]
        assert folds == [i % 5 for i in range(len(folds))]


def test_bucketed_quantiles_equal_small_path(spark, obs):
    from demandflow.operators.order import exact_quantiles
    probs = [0.1, 0.5, 0.9]
    a = exact_quantiles(obs, "demand", probs, by=["day"]).collect()
    b = exact_quantiles(obs, "demand", probs, by=["day"], n_buckets=6).collect()
    key = lambda r: (r["day"], r["q_index"])
    assert [(key(r), round(r["demand"], 12)) for r in sorted(a, key=key)] == \
           [(key(r), round(r["demand"], 12)) for r in sorted(b, key=key)]


def test_ols_from_moments_matches_numpy(spark, obs):
    from demandflow.operators.models import ols_moments, solve_ols
    bp = base_predictions(obs)
    beta = solve_ols(ols_moments(bp, ["pa", "pb", "pc"], "demand"), ["pa", "pb", "pc"], "demand")
    p = bp.toPandas()
    X = np.column_stack([np.ones(len(p)), p.pa, p.pb, p.pc])
    exp = np.linalg.lstsq(X, p.demand.values, rcond=None)[0]
    got = [beta["intercept"], beta["pa"], beta["pb"], beta["pc"]]
    assert np.allclose(got, exp, rtol=1e-6, atol=1e-8)


def test_key_coverage_with_empty_sample_has_null_shares(spark, obs):
    r = sp.key_coverage(obs, obs.limit(0), ["geohash"]).first()
    assert r["n_b"] == 0 and r["pct_shared"] is None and r["n_a"] > 0
