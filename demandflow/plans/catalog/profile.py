"""P1-P16 profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.numeric import round_doubles
from demandflow.operators import profile as pr
from demandflow.plans.common import obs, ref_of, tgt_of
from demandflow.plans.registry import BP_SQL, R, register, with_obs
from demandflow.sources.observations import OBS_COLUMNS, base_predictions

_NUMERIC = ["demand", "number_of_lanes", "temperature", "day", "idx"]
_CATS = ["geohash", "road_type", "large_vehicles", "landmarks", "weather"]


def _rd(expr, dp):
    return f"(round(({expr}) * {10.0 ** dp}) / {10.0 ** dp} + 0.0)"


@register("table_shape", with_obs("SELECT count(*) AS n_rows, 11 AS n_cols FROM obs"))
def q_table_shape(spark, sf):
    """Rows and columns of the observation table."""
    return pr.table_shape(obs(spark, sf))


_TYPE_NAMES = "CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE t END"


@register("column_types", with_obs(" UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{c}' AS column, {_TYPE_NAMES} AS dtype FROM (SELECT typeof({c}) AS t FROM obs LIMIT 1) x{i}" for i, c in enumerate(OBS_COLUMNS))))
def q_column_types(spark, sf):
    """Columns and types of the observation table."""
    return pr.column_types(obs(spark, sf))


@register("missing_report", with_obs(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, cast(sum(cast({c} IS NULL AS int)) AS bigint) AS missing_count, "
        f"{_rd(f'sum(cast({c} IS NULL AS int)) * 100.0 / count(*)', 2)} AS missing_pct FROM obs"
        for c in OBS_COLUMNS) + ") x WHERE missing_count > 0"))
def q_missing_report(spark, sf):
    """Null count and percent per column, columns with nulls only."""
    return pr.missing_report(obs(spark, sf))


@register("duplicate_rows", with_obs("""
SELECT (SELECT count(*) FROM obs) - (SELECT count(*) FROM (SELECT DISTINCT * FROM obs) a) AS duplicate_rows,
       (SELECT count(*) FROM obs) - (SELECT count(*) FROM (SELECT DISTINCT geohash, day, timestamp, demand, road_type,
          number_of_lanes, large_vehicles, landmarks, temperature, weather FROM obs) b) AS duplicate_rows_without_id"""))
def q_duplicate_rows(spark, sf):
    """Fully duplicated rows beyond the first copy (with and without the id)."""
    o = obs(spark, sf)
    a = pr.duplicate_rows(o)
    b = pr.duplicate_rows(o, [c for c in OBS_COLUMNS if c != "idx"]).withColumnRenamed(
        "duplicate_rows", "duplicate_rows_without_id")
    return a.crossJoin(b)


@register("duplicate_keys", with_obs(f"""
SELECT idx, o.day, o.geohash, o.timestamp, {R('demand')} AS demand, n_copies
FROM obs o JOIN (SELECT day, geohash, timestamp, count(*) AS n_copies FROM obs GROUP BY 1, 2, 3 HAVING count(*) > 1) d
ON o.day IS NOT DISTINCT FROM d.day AND o.geohash IS NOT DISTINCT FROM d.geohash AND o.timestamp IS NOT DISTINCT FROM d.timestamp"""))
def q_duplicate_keys(spark, sf):
    """All rows sharing (day, geohash, timestamp) with another row."""
    d = pr.duplicate_keys(obs(spark, sf), ["day", "geohash", "timestamp"])
    return round_doubles(d.select("idx", "day", "geohash", "timestamp", "demand", "n_copies"))


@register("cardinality", with_obs(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_unique FROM obs" for c in OBS_COLUMNS)))
def q_cardinality(spark, sf):
    """P5 / U4: distinct values per column."""
    return pr.cardinality(obs(spark, sf))


@register("describe_numeric", with_obs(" UNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS count, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, "
    f"{R(f'min({c})')} AS min, {R(f'quantile_cont({c}, 0.25)')} AS p25, {R(f'quantile_cont({c}, 0.5)')} AS p50, "
    f"{R(f'quantile_cont({c}, 0.75)')} AS p75, {R(f'max({c})')} AS max FROM obs" for c in _NUMERIC)))
def q_describe_numeric(spark, sf):
    """describe() with exact quartiles."""
    return round_doubles(pr.describe_numeric(obs(spark, sf), _NUMERIC))


@register("top_values", with_obs("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, value, n, cast(row_number() OVER (ORDER BY n DESC, value) AS int) AS rank "
    f"FROM (SELECT cast({c} AS varchar) AS value, count(*) AS n FROM obs WHERE {c} IS NOT NULL GROUP BY 1) v"
    for c in _CATS) + ") t WHERE rank <= 10"))
def q_top_values(spark, sf):
    """Top-10 value counts per categorical column."""
    return pr.top_values(obs(spark, sf), _CATS, 10)


def _share_sql(src, c):
    return (f"(SELECT {c} AS level, count(*) * 1.0 / (SELECT count({c}) FROM {src}) AS s FROM {src} "
            f"WHERE {c} IS NOT NULL GROUP BY {c})")


@register("distribution_compare", with_obs(" UNION ALL ".join(
    f"SELECT '{c}' AS column, coalesce(a.level, b.level) AS level, {_rd('a.s', 4)} AS share_reference, "
    f"{_rd('b.s', 4)} AS share_target FROM {_share_sql('rf', c)} a FULL JOIN {_share_sql('tg', c)} b "
    f"ON a.level = b.level" for c in ["road_type", "weather"]),
    "rf AS (SELECT * FROM obs WHERE day <= 20)", "tg AS (SELECT * FROM obs WHERE day > 20)"))
def q_distribution_compare(spark, sf):
    """Level shares in the reference vs target period, 4 dp, side by side."""
    o = obs(spark, sf)
    a, b = ref_of(o), tgt_of(o)
    return pr.distribution_compare(a, b, ["road_type", "weather"], ("reference", "target"))


_HIST = [("demand", 100), ("temperature", 50), ("number_of_lanes", 10)]


@register("histogram", with_obs(" UNION ALL ".join(
    f"SELECT cast(CASE WHEN mx = mn THEN 0 ELSE least(floor(({c} - mn) / (mx - mn) * {n}), {n - 1}) END AS int) AS bin, "
    f"count(*) AS n, '{c}' AS series FROM obs CROSS JOIN (SELECT min({c}) AS mn, max({c}) AS mx FROM obs) r "
    f"WHERE {c} IS NOT NULL GROUP BY 1" for c, n in _HIST)))
def q_histogram(spark, sf):
    """Equal-width histograms (100 / 50 / 10 bins)."""
    return pr.histograms(obs(spark, sf), {c: (c, n) for c, n in _HIST})


@register("histogram_log", with_obs(
    "SELECT cast(CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) / (mx - mn) * 100), 99) END AS int) AS bin, count(*) AS n, 'log1p_demand' AS series "
    "FROM (SELECT ln(1 + demand) AS v FROM obs WHERE demand IS NOT NULL) o CROSS JOIN (SELECT min(ln(1 + demand)) AS mn, max(ln(1 + demand)) AS mx FROM obs) r GROUP BY 1"))
def q_histogram_log(spark, sf):
    """The histogram of the log target beside the raw one (ln(1 + x), 100 bins)."""
    o = obs(spark, sf).withColumn("log1p_demand", F.log(F.lit(1.0) + F.col("demand")))
    return pr.histograms(o, {"log1p_demand": ("log1p_demand", 100)})


_MISS_COLS = ["road_type", "number_of_lanes", "temperature", "weather"]


@register("missing_pattern", with_obs(
    "SELECT idx, " + ", ".join(f"cast({c} IS NULL AS int) AS {c}_isnull" for c in _MISS_COLS)
    + " FROM obs ORDER BY idx LIMIT 500"))
def q_missing_pattern(spark, sf):
    """P10: null flags of the first 500 rows (columns that have nulls at all)."""
    o = obs(spark, sf)
    rep = pr.missing_report(o).select("column").collect()  # <= one row per column
    cols = [r["column"] for r in rep]
    cols = [c for c in OBS_COLUMNS if c in cols]
    return pr.missing_pattern(o, "idx", 500, cols)


_CORR = ["day", "number_of_lanes", "temperature", "demand"]


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@register("corr_matrix", with_obs(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS r FROM d" for a, b in _pairs(_CORR)),
    "d AS (SELECT * FROM obs WHERE day IS NOT NULL AND number_of_lanes IS NOT NULL AND temperature IS NOT NULL "
    "AND demand IS NOT NULL)"))
def q_corr_matrix(spark, sf):
    """Pearson matrix with listwise deletion (long form)."""
    return round_doubles(pr.corr_long(obs(spark, sf), _CORR))


_PRED = ["pa", "pb", "pc", "demand", "idx"]


@register("prediction_corr", with_obs(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})')} AS r FROM bp" for a, b in _pairs(_PRED)), *BP_SQL))
def q_prediction_corr(spark, sf):
    """Pairwise Pearson between the base predictions, the id and the target."""
    return round_doubles(pr.corr_long(base_predictions(obs(spark, sf)), _PRED, listwise=False))


_SP = ["pa", "pb", "pc", "demand"]


@register("spearman_corr", with_obs(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr(r_{a}, r_{b})')} AS r FROM rk" for a, b in _pairs(_SP)), *BP_SQL,
    "rk AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _SP)
    + " FROM bp)"))
def q_spearman_corr(spark, sf):
    """Spearman = Pearson of average-tie ranks."""
    return round_doubles(pr.spearman_long(base_predictions(obs(spark, sf), materialize=True), _SP, "idx"))


_TBC = ["weather", "road_type", "large_vehicles", "landmarks"]


@register("target_by_category", with_obs(" UNION ALL ".join(
    f"SELECT cast({c} AS varchar) AS level, {R('avg(demand)')} AS mean_target, count(*) AS n, '{c}' AS column "
    f"FROM obs WHERE {c} IS NOT NULL GROUP BY {c}" for c in _TBC)))
def q_target_by_category(spark, sf):
    """Mean target per level."""
    return round_doubles(pr.target_by_category(obs(spark, sf), _TBC, "demand"))


@register("iqr_outliers", with_obs(f"""
SELECT {R('q1')} AS q1, {R('q3')} AS q3, {R('q3 - q1')} AS iqr,
  count(CASE WHEN demand < q1 - 1.5 * (q3 - q1) OR demand > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers,
  {R('min(demand)')} AS min_value, {R('max(demand)')} AS max_value,
  {R('count(CASE WHEN demand < q1 - 1.5 * (q3 - q1) OR demand > q3 + 1.5 * (q3 - q1) THEN 1 END) * 100.0 / count(*)')}
    AS outlier_pct
FROM obs CROSS JOIN (SELECT quantile_cont(demand, 0.25) AS q1, quantile_cont(demand, 0.75) AS q3 FROM obs) q
GROUP BY q1, q3"""))
def q_iqr_outliers(spark, sf):
    """IQR outliers of the target."""
    return round_doubles(pr.iqr_outliers(obs(spark, sf), "demand"))


@register("id_leakage", with_obs(f"""
SELECT min(idx) AS train_min, max(idx) AS train_max, {R('corr(idx, demand)')} AS id_target_corr,
  (SELECT min(idx) FROM obs WHERE day > 20) AS test_min, (SELECT max(idx) FROM obs WHERE day > 20) AS test_max,
  cast(abs(corr(idx, demand)) < 0.05 AS int) AS non_informative
FROM obs WHERE day <= 20"""))
def q_id_leakage(spark, sf):
    """Id ranges, id-target correlation and verdict."""
    o = obs(spark, sf)
    return round_doubles(pr.id_leakage(ref_of(o), tgt_of(o), "idx", "demand"))
