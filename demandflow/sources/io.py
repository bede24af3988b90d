"""IO1-IO7: typed CSV/parquet reads, prediction alignment, writes, output contract.

Scratch and hand-off files go under the session's checkpoint folder
(``spark.checkpoint.dir`` -- a shared folder on a cluster), never a
machine-local temp folder.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandflow.session import ensure_checkpoint_dir

# The input file's columns in the reference (CamelCase) and ours.
REFERENCE_COLUMNS = {
    "Index": "idx", "geohash": "geohash", "day": "day", "timestamp": "timestamp", "RoadType": "road_type",
    "NumberofLanes": "number_of_lanes", "LargeVehicles": "large_vehicles", "Landmarks": "landmarks",
    "Temperature": "temperature", "Weather": "weather", "demand": "demand",
}

OBS_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("geohash", T.StringType()),
    T.StructField("day", T.IntegerType()), T.StructField("timestamp", T.StringType()),
    T.StructField("demand", T.DoubleType()), T.StructField("road_type", T.StringType()),
    T.StructField("number_of_lanes", T.DoubleType()), T.StructField("large_vehicles", T.StringType()),
    T.StructField("landmarks", T.StringType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("weather", T.StringType()),
])

# Texts read as missing (pandas' defaults that occur in practice).
NULL_TEXTS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/demandflow-io/{name}-{uuid.uuid4().hex}"


def read_observations(spark: SparkSession, path: str, fmt: str = "csv", reference_names: bool = False,
                      schema: T.StructType | None = None) -> DataFrame:
    """IO1: read observations with an explicit schema (no inference); every
    pandas-style missing text becomes null; NaN doubles become null."""
    schema = schema or OBS_SCHEMA
    if reference_names:
        inv = {v: k for k, v in REFERENCE_COLUMNS.items()}
        schema = T.StructType([T.StructField(inv.get(f.name, f.name), f.dataType) for f in schema.fields])
    if fmt == "csv":
        # CSV columns bind by position: order the typed schema by the file's own header
        # (a file without some column, e.g. the test file without the target, also works)
        header = spark.read.option("header", True).csv(path).columns
        types = {f.name: f.dataType for f in schema.fields}
        schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    else:
        df = spark.read.schema(schema).format(fmt).load(path)
    if reference_names:
        df = df.select([F.col(k).alias(v) for k, v in REFERENCE_COLUMNS.items() if k in df.columns])
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(F.trim(c).isin(NULL_TEXTS), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(cols)


@dataclass
class Ingested:
    """good: typed rows; bad: rows with a value that its column's type cannot hold (all texts as they stood, and the names of
    the columns that are wrong); counts: rows, bad rows, and missing and malformed values of each column."""

    good: DataFrame
    bad: DataFrame
    counts: dict


def ingest_observations(spark: SparkSession, path: str, out: str | None = None, reference_names: bool = False, schema: T.StructType | None = None) -> Ingested:
    """IO1 with nothing lost without a word: a header CSV is read once, as texts; typed values, raw texts of bad rows and the counters
    all come out of that pass.  Missing texts become null and are counted; a text that does not cast is malformed: its row goes to
    the bad side.  A row of too many or too few fields is bad as well (column ``_fields``)."""
    schema = schema or OBS_SCHEMA
    out = out or scratch_path(spark, "ingested")
    header = spark.read.option("header", True).csv(path).columns
    inv = REFERENCE_COLUMNS if reference_names else {c: c for c in header}
    names = [inv.get(c, c) for c in header]
    types = {f.name: f.dataType for f in schema.fields}
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(texts).option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_corrupt").csv(path)

    def present(c):
        return F.when(~F.trim(c).isin(NULL_TEXTS), F.col(c))

    typed, wrong, seen = {}, {}, {}
    for n in names:
        kind = types.get(n, T.StringType())
        value = present(n)
        if not isinstance(kind, T.StringType):
            value = F.trim(value).try_cast(kind)
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                value = F.when(~F.isnan(value), value)
        typed[n], seen[n] = value, present(n).isNotNull()
        wrong[n] = seen[n] & value.isNull()
    bad = F.array_compact(F.array(*[F.when(wrong[n], F.lit(n)) for n in names], F.when(F.col("_corrupt").isNotNull(), F.lit("_fields"))))
    rows = raw.select(bad.alias("_bad_columns"), F.struct(*[typed[n].alias(n) for n in names]).alias("_typed"),
                      F.struct(*names, "_corrupt").alias("_raw"), *[wrong[n].alias(f"_wrong_{n}") for n in names], *[(~seen[n]).alias(f"_missing_{n}") for n in names])
    watch = Observation("ingest")
    rows = rows.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_bad_columns") > 0).alias("bad_rows"),
                        *[F.count_if(F.col(f"_missing_{n}")).alias(f"missing_{n}") for n in names], *[F.count_if(F.col(f"_wrong_{n}")).alias(f"malformed_{n}") for n in names])
    is_bad = F.size("_bad_columns") > 0
    stored = rows.select(is_bad.alias("_is_bad"), "_bad_columns", F.when(~is_bad, F.col("_typed")).alias("_typed"), F.when(is_bad, F.col("_raw")).alias("_raw"))
    stored.write.mode("overwrite").partitionBy("_is_bad").parquet(out)
    back = spark.read.schema(stored.schema).parquet(out)
    return Ingested(back.where(~F.col("_is_bad")).select("_typed.*"), back.where("_is_bad").select(F.col("_bad_columns").alias("bad_columns"), "_raw.*"), watch.get)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """IO4: write predictions / reports (header CSV for the hand-off, parquet otherwise)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_json_row(spark: SparkSession, values: dict, path: str) -> str:
    """IO5: persist a small flat config (blend weights, chosen variant) as one JSON row."""
    spark.createDataFrame([tuple(values.values())], list(values.keys())).coalesce(1) \
         .write.mode("overwrite").json(path)
    return path


def read_json_row(spark: SparkSession, path: str) -> dict:
    return spark.read.json(path).first().asDict()


def check_output(preds: DataFrame, template: DataFrame, key: str = "idx", pred: str = "demand") -> DataFrame:
    """IO7: the output contract -- row count vs template, nulls, negatives, range,
    and ids missing / extra (anti joins both ways)."""
    p = preds.select(key, pred)
    t = template.select(key).distinct()
    stats = p.agg(F.count(F.lit(1)).alias("n_pred"),
                  F.count(F.when(F.col(pred).isNull() | F.isnan(pred), 1)).alias("n_null"),
                  F.count(F.when(F.col(pred) < 0, 1)).alias("n_negative"),
                  F.min(pred).alias("min_pred"), F.max(pred).alias("max_pred"))
    nt = t.agg(F.count(F.lit(1)).alias("n_template"))
    missing = t.join(p.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing_ids"))
    extra = p.select(key).distinct().join(t, key, "left_anti").agg(F.count(F.lit(1)).alias("n_extra_ids"))
    out = nt.crossJoin(stats).crossJoin(missing).crossJoin(extra)
    ok = ((F.col("n_pred") == F.col("n_template")) & (F.col("n_null") == 0) & (F.col("n_negative") == 0)
          & (F.col("n_missing_ids") == 0) & (F.col("n_extra_ids") == 0))
    return out.withColumn("contract_ok", ok.cast("int"))
