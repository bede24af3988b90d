"""IO1, IO3, IO7: typed reads, projection, output contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandflow.functions.numeric import r6, round_doubles
from demandflow.operators import forecast as fc
from demandflow.plans.catalog.forecast import _TS
from demandflow.plans.common import obs, obs_t, ref_of, tgt_of
from demandflow.plans.registry import R, register, with_obs
from demandflow.sources import io
from demandflow.sources.observations import OBS_COLUMNS


@register("read_observations", with_obs(
    f"SELECT idx, geohash, day, timestamp, {R('demand')} AS demand, road_type, number_of_lanes, large_vehicles, "
    "landmarks, temperature, weather FROM obs"))
def q_read_observations(spark, sf):
    """IO1 + IO4: write the observation table as a header CSV with the reference's
    column names and read it back with an explicit schema (blank/NA -> null)."""
    o = obs(spark, sf)
    inv = {v: k for k, v in io.REFERENCE_COLUMNS.items()}
    path = io.scratch_path(spark, "observations-csv")
    io.write_table(o.select([F.col(c).alias(inv[c]) for c in o.columns]), path, "csv")
    back = io.read_observations(spark, path, "csv", reference_names=True)
    return back.withColumn("demand", r6("demand"))


@register("project_index", with_obs("SELECT idx FROM obs WHERE day > 20"))
def q_project_index(spark, sf):
    """IO3: project the id column only (the scan reads one column)."""
    return tgt_of(obs(spark, sf)).select("idx")


@register("output_contract", with_obs(f"""
SELECT (SELECT count(*) FROM tg) AS n_template, count(*) AS n_pred,
  count(CASE WHEN heur IS NULL OR isnan(heur) THEN 1 END) AS n_null, count(CASE WHEN heur < 0 THEN 1 END) AS n_negative,
  {R('min(heur)')} AS min_pred, {R('max(heur)')} AS max_pred,
  (SELECT count(*) FROM tg WHERE idx NOT IN (SELECT idx FROM feat)) AS n_missing_ids,
  (SELECT count(*) FROM feat WHERE idx NOT IN (SELECT idx FROM tg)) AS n_extra_ids,
  cast(count(*) = (SELECT count(*) FROM tg) AND count(CASE WHEN heur IS NULL OR isnan(heur) THEN 1 END) = 0
       AND count(CASE WHEN heur < 0 THEN 1 END) = 0 AS int) AS contract_ok
FROM feat""", *_TS))
def q_output_contract(spark, sf):
    """IO7: contract check of the heuristic forecast against the target-period id template."""
    o = obs_t(spark, sf)
    ref, tgt = ref_of(o), tgt_of(o)
    preds = fc.ts_features(tgt, fc.fit_templates(ref, tgt)).select("idx", "heuristic_demand")
    return round_doubles(io.check_output(preds, tgt.select("idx"), "idx", "heuristic_demand"))


@register("ingest_report", with_obs(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) AS n_rows, cast(sum(cast({c} IS NULL AS int)) AS bigint) AS n_missing, "
        f"cast({'sum(cast(idx % 7 = 0 AS int))' if c == 'number_of_lanes' else '0'} AS bigint) AS n_malformed FROM "
        f"(SELECT * REPLACE (CASE WHEN idx % 7 = 0 THEN 0.0 ELSE number_of_lanes END AS number_of_lanes) FROM obs) o"
        for c in OBS_COLUMNS) + ") x"))
def q_ingest_report(spark, sf):
    """IO1 + P2: the observation table as a CSV in which every seventh row has a text for a number, read in one pass with counters."""
    o = obs(spark, sf)
    lanes = F.when(F.col("idx") % 7 == 0, "many").otherwise(F.col("number_of_lanes").cast("string"))
    path = io.write_table(o.withColumn("number_of_lanes", lanes), io.scratch_path(spark, "spoilt-csv"), "csv")
    c = io.ingest_observations(spark, path).counts
    return spark.createDataFrame([(n, c["rows"], c[f"missing_{n}"], c[f"malformed_{n}"]) for n in OBS_COLUMNS], "column string, n_rows long, n_missing long, n_malformed long")
