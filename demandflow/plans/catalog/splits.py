"""Folds, samples, coverage, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.numeric import round_doubles
from demandflow.operators import splits as sp
from demandflow.operators.leakage import leakage_audit
from demandflow.plans.catalog.order import QBIN_SQL
from demandflow.plans.common import obs, obs_t, ref_of, tgt_of
from demandflow.plans.registry import R, register, with_obs
from demandflow.sources.observations import lookup_samples

HASH = "md5(concat_ws('-', '42', cast(idx AS varchar)))"
FOLDS_SQL = (f"fo AS (SELECT qb.*, cast((row_number() OVER (PARTITION BY bin ORDER BY {HASH}, idx) - 1) % 5 AS int) "
             f"AS fold FROM qb)")


@register("stratified_folds", with_obs("SELECT idx, fold FROM fo", QBIN_SQL, FOLDS_SQL))
def q_stratified_folds(spark, sf):
    """V2: 5 folds stratified by target decile, seeded hash order (seed 42)."""
    return sp.target_decile_folds(obs(spark, sf), "demand", "idx").select("idx", "fold")


@register("adversarial_folds", with_obs(f"""
SELECT idx, is_test, cast((row_number() OVER (PARTITION BY is_test ORDER BY {HASH}, idx) - 1) % 5 AS int) AS fold
FROM (SELECT idx, 0 AS is_test FROM obs WHERE day <= 20 UNION ALL SELECT idx, 1 FROM obs WHERE day > 20) u"""))
def q_adversarial_folds(spark, sf):
    """V3: folds on train U test stratified by the source flag."""
    o = obs(spark, sf)
    u = sp.union_flagged(ref_of(o).select("idx"), tgt_of(o).select("idx"))
    return sp.stratified_folds(u, "is_test", "idx").select("idx", "is_test", "fold")


@register("rolling_folds", with_obs("""
SELECT cast(f.fold AS int) AS fold,
       CASE WHEN pos < n - (5 - f.fold) * (n // 6) THEN 'train' ELSE 'valid' END AS role, idx
FROM (SELECT idx, row_number() OVER (ORDER BY day, slot, idx) - 1 AS pos, count(*) OVER () AS n
      FROM obs_t WHERE day <= 20) p
CROSS JOIN (SELECT range AS fold FROM range(5)) f
WHERE pos < n - (5 - f.fold) * (n // 6) + (n // 6)"""))
def q_rolling_folds(spark, sf):
    """V4 + W6: expanding-window folds over the reference period in (day, slot, idx) order."""
    return sp.rolling_folds(ref_of(obs_t(spark, sf)), ["day", "slot", "idx"], "idx").select("fold", "role", "idx")


@register("hash_sample", with_obs(f"SELECT idx, demand FROM obs ORDER BY {HASH}, idx LIMIT 2000"))
def q_hash_sample(spark, sf):
    """V6: reproducible 2,000-row sample (seed 42)."""
    return sp.hash_sample(obs(spark, sf), "idx", 2000).select("idx", "demand")


def _cov_sql(name, key_expr, a, b):
    da = f"(SELECT DISTINCT {key_expr} FROM {a} WHERE {_nn(key_expr)})"
    db = f"(SELECT DISTINCT {key_expr} FROM {b} WHERE {_nn(key_expr)})"
    shared = f"(SELECT count(*) FROM ({da} INTERSECT {db}) s)"
    unseen = f"(SELECT count(*) FROM ({db} EXCEPT {da}) s)"
    nb = f"(SELECT count(*) FROM {db} s)"
    return (f"SELECT '{name}' AS key, (SELECT count(*) FROM {da} s) AS n_a, {nb} AS n_b, {shared} AS n_shared, "
            f"{unseen} AS n_unseen_in_b, {R(f'{shared} * 100.0 / {nb}')} AS pct_shared, "
            f"{R(f'{unseen} * 100.0 / {nb}')} AS pct_unseen")


def _nn(key_expr):
    return " AND ".join(f"{k.strip()} IS NOT NULL" for k in key_expr.split(","))


_KEYSETS = [("geohash", "geohash"), ("timestamp", "timestamp"), ("geohash+timestamp", "geohash, timestamp")]


@register("key_coverage", with_obs(" UNION ALL ".join(_cov_sql(n, k, "rf", "tg") for n, k in _KEYSETS),
                                   "rf AS (SELECT * FROM obs WHERE day <= 20)",
                                   "tg AS (SELECT * FROM obs WHERE day > 20)"))
def q_key_coverage(spark, sf):
    """J8 + U2 + U3 + U4: shared and unseen keys, reference vs target period."""
    o = obs(spark, sf)
    a, b = ref_of(o), tgt_of(o)
    return round_doubles(sp.coverage_report(a, b, {"geohash": ["geohash"], "timestamp": ["timestamp"],
                                                   "geohash+timestamp": ["geohash", "timestamp"]}))


@register("geo_time_overlap", with_obs(_cov_sql("geo_ts", "geo_ts", "la", "lb"),
    "la AS (SELECT geohash || '_' || timestamp AS geo_ts FROM obs WHERE idx % 5 <> 0)",
    "lb AS (SELECT geohash || '_' || timestamp AS geo_ts FROM obs WHERE idx % 5 = 0)"))
def q_geo_time_overlap(spark, sf):
    """F16 + J8: composite ``geohash_timestamp`` keys, lookup-train vs lookup-test overlap."""
    train, test = lookup_samples(obs(spark, sf))
    k = F.concat("geohash", F.lit("_"), "timestamp").alias("geo_ts")  # null where a part is
    return round_doubles(sp.key_coverage(train.select(k), test.select(k), ["geo_ts"], "geo_ts"))


@register("leakage_report", with_obs(
    "SELECT *, CASE WHEN pct_shared >= 10.0 THEN 'high_overlap' ELSE 'low_overlap' END AS verdict FROM ("
    + " UNION ALL ".join(_cov_sql(n, k, "fa", "fb") for n, k in _KEYSETS) + ") x",
    QBIN_SQL, FOLDS_SQL, "fa AS (SELECT * FROM fo WHERE fold <> 0)", "fb AS (SELECT * FROM fo WHERE fold = 0)"))
def q_leakage_report(spark, sf):
    """V7: fold-0 validation vs the other folds: key overlap per key set and verdict."""
    f = sp.target_decile_folds(obs(spark, sf), "demand", "idx")
    rep = sp.leakage_report(f.where(F.col("fold") != 0), f.where(F.col("fold") == 0),
                            {"geohash": ["geohash"], "timestamp": ["timestamp"],
                             "geohash+timestamp": ["geohash", "timestamp"]})
    return round_doubles(rep)


_AUDIT_PAIRS = {"folds": ("fold_train", "fold_valid"), "train_test": ("train", "test")}
_CATEGORIES = ["road_type", "weather"]


def _audit_sql() -> str:
    """Every part of the audit by plain set and count queries over the samples."""
    parts = []
    for name, (a, b) in _AUDIT_PAIRS.items():
        for item, key in _KEYSETS:
            one = _cov_sql(item, key, a, b)
            parts.append(f"SELECT 'overlap' AS part, '{name}' AS comparison, key AS item, NULL AS level, n_a, n_b, n_shared, pct_shared AS pct_a, pct_unseen AS pct_b, "
                         f"CASE WHEN pct_shared >= 10 THEN 'high_overlap' ELSE 'low_overlap' END AS verdict FROM ({one}) x")
        for c in _CATEGORIES:
            def share(t, c=c):
                return f"(SELECT {c} AS v, count(*) AS n, count(*) * 100.0 / (SELECT count({c}) FROM {t}) AS pct FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"
            parts.append(f"SELECT 'share', '{name}', '{c}', coalesce(x.v, y.v), coalesce(x.n, 0), coalesce(y.n, 0), least(coalesce(x.n, 0), coalesce(y.n, 0)), "
                         f"{R('coalesce(x.pct, 0.0)')}, {R('coalesce(y.pct, 0.0)')}, CASE WHEN abs(coalesce(x.pct, 0.0) - coalesce(y.pct, 0.0)) > 5 THEN 'shifted' ELSE 'alike' END "
                         f"FROM {share(a)} x FULL JOIN {share(b)} y ON x.v = y.v")
    parts.append(f"SELECT 'repeated', 'train', 'geohash+timestamp', NULL, cast(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS bigint), count(*) FILTER (WHERE n > 1), 0, "
                 f"{R('sum(CASE WHEN n > 1 THEN n ELSE 0 END) * 100.0 / sum(n)')}, {R('count(*) FILTER (WHERE n > 1) * 100.0 / count(*)')}, "
                 "CASE WHEN max(n) > 1 THEN 'repeated' ELSE 'unique' END FROM (SELECT count(*) AS n FROM train WHERE geohash IS NOT NULL AND timestamp IS NOT NULL GROUP BY geohash, timestamp) k")
    for item, key in _KEYSETS:
        f, t = (f"(SELECT pct_shared FROM ({_cov_sql(item, key, a, b)}) x)" for a, b in _AUDIT_PAIRS.values())
        parts.append(f"SELECT 'verdict', 'folds/train_test', '{item}', NULL, NULL, NULL, NULL, {f}, {t}, "
                     f"CASE WHEN {f} < 10 THEN 'safe' WHEN {t} < 10 THEN 'folds_leak' ELSE 'known_keys' END")
    samples = {"train": "idx % 5 <> 0", "test": "idx % 5 = 0", "fold_train": "idx % 5 <> 0 AND fold <> 0", "fold_valid": "idx % 5 <> 0 AND fold = 0"}
    return with_obs(" UNION ALL ".join(parts), QBIN_SQL, FOLDS_SQL, *[f"{n} AS (SELECT * FROM fo WHERE {w})" for n, w in samples.items()])


@register("leakage_audit", _audit_sql())
def q_leakage_audit(spark, sf):
    """V7: key overlaps, category shares, repeated keys and verdicts of fold 0 against the other folds and of the labelled against
    the unlabelled rows, from one aggregate."""
    f = sp.target_decile_folds(obs(spark, sf), "demand", "idx")
    train = F.col("idx") % 5 != 0
    samples = {"train": train, "test": ~train, "fold_train": train & (F.col("fold") != 0), "fold_valid": train & (F.col("fold") == 0)}
    return round_doubles(leakage_audit(f, samples, _AUDIT_PAIRS, {"geohash": ["geohash"], "timestamp": ["timestamp"], "geohash+timestamp": ["geohash", "timestamp"]},
                                       _CATEGORIES, ("train", "geohash+timestamp")))


@register("union_flagged", with_obs("""
SELECT idx, 0 AS is_test FROM obs WHERE day <= 20 UNION ALL SELECT idx, 1 AS is_test FROM obs WHERE day > 20"""))
def q_union_flagged(spark, sf):
    """Union of the two periods with a source flag."""
    o = obs(spark, sf)
    return sp.union_flagged(ref_of(o).select("idx"), tgt_of(o).select("idx"))
