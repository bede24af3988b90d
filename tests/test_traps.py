"""Golden unit tests on hand-made rows for the pandas -> Spark traps
(expected values computed with plain pandas / numpy)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandflow.functions import categorical as cat
from demandflow.functions import geo, numeric, time
from demandflow.operators import encoders as enc
from demandflow.operators import features as feat
from demandflow.operators import order
from demandflow.operators.metrics import r2_score, roc_auc


def _rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_null_group_key_is_dropped_and_unseen_gets_default(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 100.0), ("b", 5.0)], "k string, y double")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, None)], "id int, k string")
    out = enc.apply_mean(test, enc.fit_mean(train, ["k"], "y"), ["k"], "te")
    got = dict(_rows(out, "id", "te"))
    g = np.mean([1.0, 3.0, 100.0, 5.0])
    assert got == {1: 2.0, 2: 5.0, 3: g, 4: g}


def test_smoothed_encoding_matches_pandas(spark):
    pdf = pd.DataFrame({"k": list("aaabbc"), "y": [1.0, 2.0, 3.0, 10.0, 20.0, 7.0]})
    df = spark.createDataFrame(pdf)
    out = enc.apply_smoothed(df, enc.fit_smoothed(df, ["k"], "y", alpha=10), ["k"], "te")
    g = pdf.y.mean()
    agg = pdf.groupby("k").y.agg(["mean", "count"])
    exp = ((agg["mean"] * agg["count"] + g * 10) / (agg["count"] + 10)).to_dict()
    for k, v in _rows(out, "k", "te"):
        assert v == pytest.approx(exp[k], abs=1e-12)


def test_single_row_group_std_is_null_then_zero_when_asked(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, t double")
    plain = dict(_rows(enc.fit_group_stats(df, "k", "t", "p", stats=("std",)), "k", "p_std"))
    filled = dict(_rows(enc.fit_group_stats(df, "k", "t", "p", stats=("std",), std_null_as_zero=True), "k", "p_std"))
    assert plain["b"] is None and filled["b"] == 0.0
    assert plain["a"] == pytest.approx(pd.Series([1.0, 3.0]).std())


def test_clip_keeps_null_and_nan(spark):
    df = spark.createDataFrame([(1, -0.5), (2, 0.5), (3, 1.5), (4, None), (5, float("nan"))], "i int, x double")
    got = dict(_rows(df.select("i", numeric.clip("x", 0.0, 1.0).alias("c")), "i", "c"))
    assert got[1] == 0.0 and got[2] == 0.5 and got[3] == 1.0 and got[4] is None and math.isnan(got[5])


def test_floor_modulo_and_division_on_negative_days(spark):
    df = spark.createDataFrame([(-3,), (0,), (12,)], "day int")
    got = _rows(time.day_features(df), "day", "day_of_week", "week_number", "is_weekend")
    exp = [(d, d % 7, d // 7, int(d % 7 in (5, 6))) for d in (-3, 0, 12)]
    assert sorted(got) == sorted(exp)


def test_unpadded_timestamp_parses(spark):
    df = spark.createDataFrame([("7:5",), ("23:45",), ("0:0",)], "timestamp string")
    got = _rows(time.time_slots(time.parse_time(df)), "timestamp", "hour", "minute", "quarter_hour")
    assert sorted(got) == sorted([("7:5", 7, 5, 28), ("23:45", 23, 45, 95), ("0:0", 0, 0, 0)])


def test_equal_width_bins_match_pandas_cut(spark):
    x = [0.0, 1.0, 2.5, 3.0, 7.7, 10.0, 4.0, 4.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    got = dict(_rows(feat.equal_width_bins(df, "x", {"b5": 5}), "i", "b5"))
    exp = pd.cut(pd.Series(x), bins=5, labels=False)
    assert [got[i] for i in range(len(x))] == list(exp)


def test_qcut_with_duplicate_edges(spark):
    x = [0.0] * 6 + [1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    got = dict(_rows(order.quantile_bins(df, "x", 10, "b"), "i", "b"))
    exp = pd.qcut(pd.Series(x), q=10, labels=False, duplicates="drop")
    assert [got[i] for i in range(len(x))] == list(exp)


@pytest.mark.parametrize("n_buckets", [None, 4])
def test_average_rank_matches_pandas_including_hot_value(spark, n_buckets):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 50, 300).astype(float), np.full(300, 7.0)])
    keys = rng.integers(0, 3, len(x))
    pdf = pd.DataFrame({"i": range(len(x)), "g": keys, "x": x})
    df = spark.createDataFrame(pdf)
    pos = order.value_positions(df, "x", ["g"], n_buckets=n_buckets)
    ranks = df.join(pos.select("g", F.col("x").alias("x"),
                               (F.col("below") + (F.col("cnt") + 1) / 2.0).alias("r")), ["g", "x"])
    got = dict(_rows(ranks, "i", "r"))
    exp = pdf.groupby("g").x.rank(method="average")
    assert all(got[i] == pytest.approx(exp[i]) for i in range(len(x)))


@pytest.mark.parametrize("n_buckets", [None, 5])
def test_exact_quantiles_match_numpy(spark, n_buckets):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "x": rng.normal(size=400).round(2)})
    pdf.loc[pdf.g == 0, "x"] = 1.25  # constant group
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["q_index"]): r["x"] for r in
           order.exact_quantiles(df, "x", probs, by=["g"], n_buckets=n_buckets).collect()}
    for g, s in pdf.groupby("g").x:
        for i, p in enumerate(probs):
            assert got[(g, i)] == pytest.approx(np.quantile(s, p), abs=1e-12)


def test_label_codes_put_null_as_nan_text(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("Z",), ("a",)], "c string")
    codes = dict(_rows(enc.fit_label_codes([df], "c"), "_txt", "code"))
    assert codes == {t: i for i, t in enumerate(sorted(["b", "nan", "a", "Z"]))}


def test_r2_constant_target_rule(spark):
    perfect = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    off = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert r2_score(perfect, "y", "p").first()["r2"] == 1.0
    assert r2_score(off, "y", "p").first()["r2"] == 0.0


def _bisect_decode(gh):
    alpha = geo.GEOHASH_ALPHABET
    lat, lon = [-90.0, 90.0], [-180.0, 180.0]
    even = True
    for ch in gh:
        d = alpha.index(ch)
        for b in (16, 8, 4, 2, 1):
            rng = lon if even else lat
            mid = (rng[0] + rng[1]) / 2
            if d & b:
                rng[0] = mid
            else:
                rng[1] = mid
            even = not even
    return (lat[0] + lat[1]) / 2, (lon[0] + lon[1]) / 2


def test_geohash_decode_equals_bisection(spark):
    codes = ["u4pru", "9q8yyk", "s0000", "zzzzzzzzzzzz", "7"]
    df = spark.createDataFrame([(c,) for c in codes] + [(None,)], "geohash string")
    got = {r["geohash"]: (r["lat"], r["lon"]) for r in geo.geohash_decode(df).collect()}
    for c in codes:
        assert got[c] == _bisect_decode(c)
    assert got[None] == (0.0, 0.0)


def test_global_row_number_is_the_sorted_position(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.permutation(500), "v": rng.normal(size=500)})
    got = order.global_row_number(spark.createDataFrame(pdf), ["k"], n_partitions=7)
    assert sorted(_rows(got, "k", "rn")) == [(i, i + 1) for i in range(500)]


def test_quantile_map_matches_np_interp(spark):
    rng = np.random.default_rng(3)
    ys = np.round(rng.gamma(2.0, size=300), 3)
    rs = np.concatenate([[0.0, 1.0, 0.5], rng.uniform(size=97)])
    sample = spark.createDataFrame([(float(v),) for v in ys], "y double")
    q = spark.createDataFrame([(i, float(r)) for i, r in enumerate(rs)], "i int, r double")
    got = dict(_rows(order.quantile_map(q, "r", sample, "y", "m"), "i", "m"))
    exp = np.interp(rs, np.linspace(0, 1, len(ys)), np.sort(ys))
    assert all(got[i] == pytest.approx(exp[i], abs=1e-12) for i in range(len(rs)))


def test_roc_auc_matches_rank_formula(spark):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 20, 200).astype(float)
    y = (rng.uniform(size=200) < s / 25).astype(int)
    pdf = pd.DataFrame({"y": y, "s": s})
    got = roc_auc(spark.createDataFrame(pdf), "y", "s").first()["auc"]
    r = pdf.s.rank(method="average")
    npos, nneg = y.sum(), (1 - y).sum()
    exp = (r[pdf.y == 1].sum() - npos * (npos + 1) / 2) / (npos * nneg)
    assert got == pytest.approx(exp, abs=1e-12)


@pytest.mark.parametrize("chunk", [None, 7])
def test_rolling_mean_matches_pandas_with_hot_key(spark, chunk):
    rng = np.random.default_rng(5)
    g = np.where(rng.uniform(size=300) < 0.6, "hot", rng.choice(["a", "b", "c"], 300))
    pdf = pd.DataFrame({"i": range(300), "g": g, "s": rng.integers(0, 96, 300), "v": rng.normal(size=300)})
    got = dict(_rows(order.rolling_mean(spark.createDataFrame(pdf), "v", ["g"], ["s", "i"], 2, "rm",
                                        chunk_rows=chunk), "i", "rm"))
    srt = pdf.sort_values(["g", "s", "i"])
    exp = srt.groupby("g").v.transform(lambda x: x.rolling(5, center=True, min_periods=1).mean())
    assert all(got[i] == pytest.approx(exp[i], abs=1e-12) for i in range(300))


def test_ordinal_unknown_is_null(spark):
    df = spark.createDataFrame([("Sunny",), ("Foggy",), (None,)], "weather string")
    got = [r[0] for r in df.select(cat.ordinal("weather", cat.WEATHER_CODES)).collect()]
    assert got == [0, None, None]


@pytest.fixture
def force_bucketed(spark):
    """Make every order operator take its at-scale (bucketed) plan."""
    spark.conf.set("demandflow.order.smallDistinct", "10")
    spark.conf.set("demandflow.order.positionChunk", "7")  # hot values span many chunks
    yield
    spark.conf.unset("demandflow.order.smallDistinct")
    spark.conf.unset("demandflow.order.positionChunk")


def test_bucketed_paths_match_pandas(spark, force_bucketed):
    rng = np.random.default_rng(11)
    x = np.concatenate([np.round(rng.gamma(2.0, size=400), 2), np.full(200, 1.5)])  # hot value
    y = (rng.uniform(size=len(x)) < 0.4).astype(int)
    pdf = pd.DataFrame({"i": range(len(x)), "x": x, "y": y})
    df = spark.createDataFrame(pdf)
    # average rank
    got = dict(_rows(order.average_rank(df, "x", "r"), "i", "r"))
    exp = pdf.x.rank(method="average")
    assert all(got[i] == pytest.approx(exp[i]) for i in range(len(x)))
    # exact quantiles through quantiles_wide (bucketed because of the limit)
    probs = [0.0, 0.13, 0.5, 0.77, 1.0]
    row = order.quantiles_wide(df, ["x"], probs).first()
    for i, p in enumerate(probs):
        assert row[f"x__q{i}"] == pytest.approx(np.quantile(x, p), abs=1e-12)
    # quantile bins
    bins = dict(_rows(order.quantile_bins(df, "x", 10, "b"), "i", "b"))
    expb = pd.qcut(pdf.x, q=10, labels=False, duplicates="drop")
    assert [bins[i] for i in range(len(x))] == list(expb)
    # AUC
    auc = roc_auc(df, "y", "x").first()["auc"]
    npos, nneg = y.sum(), (1 - y).sum()
    assert auc == pytest.approx((exp[pdf.y == 1].sum() - npos * (npos + 1) / 2) / (npos * nneg), abs=1e-12)
    # quantile map
    rs = rng.uniform(size=50)
    q = spark.createDataFrame([(i, float(r)) for i, r in enumerate(rs)], "i int, r double")
    m = dict(_rows(order.quantile_map(q, "r", df, "x", "m"), "i", "m"))
    expm = np.interp(rs, np.linspace(0, 1, len(x)), np.sort(x))
    assert all(m[i] == pytest.approx(expm[i], abs=1e-12) for i in range(len(rs)))


def test_label_codes_many_equal_per_column_codes(spark):
    df = spark.createDataFrame([("b", "x"), (None, "y"), ("a", None), ("Z", "x")], "c string, d string")
    many = {(r["column"], r["_txt"]): r["code"] for r in enc.fit_label_codes_many([df], ["c", "d"]).collect()}
    for col in ["c", "d"]:
        single = dict(_rows(enc.fit_label_codes([df], col), "_txt", "code"))
        assert single == {t: c for (k, t), c in many.items() if k == col}


@pytest.mark.parametrize("value,n", [(3.0, 5), (3.0, 10), (0.0, 10), (-2.0, 5)])
def test_constant_column_bins_match_pandas(spark, value, n):
    df = spark.createDataFrame([(i, value) for i in range(3)], "i int, x double")
    got = [r[0] for r in feat.equal_width_bins(df, "x", {"b": n}).select("b").collect()]
    assert got == list(pd.cut(pd.Series([value] * 3), bins=n, labels=False))


def test_all_null_column_stays_null_after_median_fill(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, 4.0)], "i int, a double, b double")
    out = {r["i"]: (r["a_filled"], r["b_filled"]) for r in feat.median_fill(df, ["a", "b"]).collect()}
    assert out == {1: (None, 2.0), 2: (None, 4.0)}


def test_zero_early_mean_gives_global_ratio_and_duplicate_keys_one_template_row(spark):
    from demandflow.operators import forecast as fc
    ref = spark.createDataFrame([
        (1, "aaaaa", 1, 0.0, "Highway"), (2, "bbbbb", 1, 1.0, None), (3, "ccccc", 1, 2.0, None),
        (4, "ccccc", 1, 4.0, "Highway"),  # duplicate (geohash, slot)
    ], "idx long, geohash string, slot int, demand double, road_type string")
    tgt = spark.createDataFrame([(5, "aaaaa", 1, 3.0, None), (6, "bbbbb", 1, 3.0, None), (7, "ccccc", 9, 9.0, None)],
                                "idx long, geohash string, slot int, demand double, road_type string")
    t, g = fc.trend(ref, tgt)
    rows = {r["geohash"]: r for r in t.collect()}
    gr = g.first()["global_trend_ratio"]
    # aaaaa: early ref mean 0 -> ratio null -> global median ratio (of bbbbb's 3.0 only), clipped
    assert gr == pytest.approx(3.0)
    assert rows["aaaaa"]["trend_multiplier"] == pytest.approx(3.0)
    # ccccc: no early target rows -> ratio null -> global; offset 0
    assert rows["ccccc"]["trend_offset"] == 0.0
    tpl = fc.templates_joined(ref).where(F.col("geohash") == "ccccc").collect()
    assert len(tpl) == 1 and tpl[0]["d48_lag_demand"] == pytest.approx(3.0)
