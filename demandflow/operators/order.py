"""Order-based operators without single-task windows.

A window with no ``partitionBy`` sends every row to one task.  The operators
here get global (or per-group) positions in a distributed way:

* :func:`value_positions` -- for each distinct value (per group): its row count
  and the number of rows with a smaller value.  Rows are first collapsed to
  distinct values (map-side combine, so a hot value is one row), then split
  into value buckets whose edges come from an approximate-quantile pass (a
  bounded list of edges reaches the driver).  Per-bucket totals give bucket
  offsets; a running sum inside each (group, bucket) gives the rest.  A group
  holding a third of all rows is therefore spread over many buckets/tasks.
* :func:`global_row_number` -- row numbers in a total order: range partition,
  sort within partitions, checkpoint (so partition contents are stable on
  recompute), per-partition counts (one number per partition) -> offsets.

Average ranks, exact quantiles, quantile bins, quantile mapping, ROC-AUC and
Spearman correlation are built on these.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandflow.operators.quantiles import quantile_numbers
from demandflow.session import ensure_checkpoint_dir, materialize

_UNBOUNDED = Window.unboundedPreceding


def _spark(df: DataFrame):
    return df.sparkSession


def _default_buckets(df: DataFrame) -> int:
    n = int(_spark(df).conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, min(65536, 4 * n))


# Above this many distinct (group, value) pairs the bucketed plans are used;
# below it one sort per group (or Spark's exact ``percentile`` value map) is
# bounded by the measured size.  Set ``demandflow.order.smallDistinct``.
SMALL_DISTINCT = 1_000_000


def _small_limit(df: DataFrame) -> int:
    return int(_spark(df).conf.get("demandflow.order.smallDistinct", str(SMALL_DISTINCT)))


def plan_buckets(df: DataFrame, cols: list[str], by: list[str] | tuple = ()) -> dict[str, int]:
    """Bucket count per column from ONE HyperLogLog pass over ``df``: 1 when the
    distinct (group, value) count is under the limit, else the default."""
    by = list(by)
    def key(c):
        return F.struct(*[F.col(b) for b in by], F.col(c)) if by else F.col(c)
    row = df.agg(*[F.approx_count_distinct(key(c), 0.05).alias(c) for c in cols]).first()
    limit = _small_limit(df)
    return {c: 1 if (row[c] or 0) * 1.2 <= limit else _default_buckets(df) for c in cols}


def max_group_size(df: DataFrame, keys: list[str]) -> int:
    """Rows in the largest group (one partial-aggregated count per key; one number
    reaches the driver)."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c").alias("m")).first()
    return int(row["m"] or 0)


def distinct_estimate(df: DataFrame, cols: list[str]) -> int:
    """HyperLogLog estimate of distinct value combinations (one cheap pass, no shuffle of rows)."""
    key = F.struct(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])
    return int(df.agg(F.approx_count_distinct(key, 0.05).alias("n")).first()["n"] or 0)


def _window(by) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy()


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys are kept once, from ``left``."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def bucket_edges(df: DataFrame, col: str, n_buckets: int) -> list[float]:
    """Approximate equi-depth edges of ``col`` (bounded list: n_buckets - 1 values)."""
    if n_buckets <= 1:
        return []
    probs = [i / n_buckets for i in range(1, n_buckets)]
    acc = max(10000, 20 * n_buckets)
    row = df.agg(F.percentile_approx(F.col(col), probs, acc).alias("e")).first()
    edges = row["e"] or []
    return sorted(set(float(e) for e in edges if e is not None))


def _bucketize(df: DataFrame, col: str, edges: list[float], out: str) -> DataFrame:
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf")] + edges + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out + "_d", handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out + "_d").cast("int")).drop(out + "_d")


def value_positions(df: DataFrame, value: str, by: list[str] | tuple = (),
                    sums: dict[str, Column] | None = None, n_buckets: int | None = None,
                    with_next: bool = False) -> DataFrame:
    """Distinct values with their position statistics.

    Returns ``by..., value, cnt, below, n`` (+ ``next_value`` if asked, + one
    column per entry of ``sums``) where ``cnt`` = rows with this value in the
    group, ``below`` = rows in the group with a strictly smaller value, ``n`` =
    non-null rows in the group.  Nulls and NaN are left out (pandas rank/quantile
    semantics).  ``value`` is compared as a double.
    """
    by = list(by)
    sums = sums or {}
    v = F.col(value).cast("double")
    base = df.select(*[F.col(c) for c in by], v.alias("_v"),
                     *[e.alias(k) for k, e in sums.items()])
    base = base.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    vc = base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_cnt"),
                                    *[F.sum(k).alias(k) for k in sums])
    if n_buckets is None:
        small = distinct_estimate(base, [*by, "_v"]) * 1.2 <= _small_limit(df)
        n_buckets = 1 if small else _default_buckets(df)
    if n_buckets > 1:
        # read twice (edge pass + main plan): write the distinct-value table once
        vc = materialize(vc, "value-counts")
    edges = bucket_edges(vc, "_v", n_buckets)
    vcb = _bucketize(vc, "_v", edges, "_b")

    per_bucket = vcb.groupBy(*by, "_b").agg(F.sum("_cnt").alias("_bcnt"), F.min("_v").alias("_bmin"))
    wg = _window(by)
    offs = per_bucket.select(
        *by, "_b", "_bcnt",
        F.coalesce(F.sum("_bcnt").over(wg.orderBy("_b").rowsBetween(_UNBOUNDED, -1)), F.lit(0)).alias("_boff"),
        F.sum("_bcnt").over(wg).alias("_n"),
        F.lead("_bmin").over(wg.orderBy("_b")).alias("_next_bmin"),
    )
    j = null_safe_join(vcb, offs, [*by, "_b"])
    wb = Window.partitionBy(*by, "_b").orderBy("_v")
    cols = [*[F.col(c) for c in by], F.col("_v").alias(value), F.col("_cnt").alias("cnt"),
            (F.col("_boff") + F.coalesce(F.sum("_cnt").over(wb.rowsBetween(_UNBOUNDED, -1)), F.lit(0)))
            .alias("below"),
            F.col("_n").alias("n"), F.col("_b").alias("bucket"), F.col("_boff").alias("bucket_offset"),
            F.col("_bcnt").alias("bucket_count"), *[F.col(k) for k in sums]]
    if with_next:
        cols.append(F.coalesce(F.lead("_v").over(wb), F.col("_next_bmin")).alias("next_value"))
    return j.select(*cols)


def average_rank(df: DataFrame, value: str, out: str = "rank", by: list[str] | tuple = (),
                 scaled: bool = False, n_buckets: int | None = None) -> DataFrame:
    """Average-tie rank (1-based) of ``value`` within ``by``; ``scaled`` divides by n.

    Null values get a null rank.  The rank table (one row per distinct value) is
    joined back on (by, value); AQE's skew-join split handles a hot value.
    """
    by = list(by)
    pos = value_positions(df, value, by, n_buckets=n_buckets)
    rank = F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    if scaled:
        rank = rank / F.col("n")
    ranks = pos.select(*by, F.col(value).alias("_rv"), rank.alias(out))
    keyed = df.withColumn("_rv", F.col(value).cast("double"))
    if not by:
        return keyed.join(ranks, on="_rv", how="left").drop("_rv")
    return null_safe_join(keyed, ranks, [*by, "_rv"], "left").drop("_rv")


# Positions per lookup chunk: every as-of window partition holds at most
# POSITION_CHUNK + 1 value rows plus at most POSITION_CHUNK distinct positions.
POSITION_CHUNK = 1 << 16


def values_at_positions(pos: DataFrame, value: str, targets: DataFrame, by: list[str], k: str,
                        chunk: int | None = None) -> DataFrame:
    """For each distinct (group, 0-based position ``k``) of ``targets``: the value at
    that position of the group's sorted values, and the value at ``k + 1``.

    The position axis is cut into fixed chunks; each distinct-value row of ``pos``
    (covering positions ``[below, below + cnt)``) is copied into every chunk it
    overlaps (a hot value spans many chunks, so it is spread, not piled up), and an
    as-of merge inside each (group, chunk) picks the last value row starting at or
    before ``k``.  No join emits pairs, and no window partition exceeds ~2 chunks.
    Returns ``by..., k, _y, _y_next``.
    """
    chunk = chunk or int(_spark(pos).conf.get("demandflow.order.positionChunk", str(POSITION_CHUNK)))
    c = F.lit(chunk)
    first = F.floor(F.col("below") / c).cast("long")
    last = F.floor((F.col("below") + F.col("cnt") - 1) / c).cast("long")
    vals = pos.select(*by, F.col(value).alias("_y"), "below", "cnt", "next_value",
                      F.explode(F.sequence(first, last)).alias("_chunk"))
    q = targets.select(*by, F.col(k).cast("long").alias("_k")).distinct() \
               .withColumn("_chunk", F.floor(F.col("_k") / c).cast("long"))
    v = vals.select(*by, "_chunk", F.col("below").alias("_key"), F.lit(0).alias("_kind"),
                    F.struct("_y", "below", "cnt", "next_value").alias("_val"))
    qq = q.select(*by, "_chunk", F.col("_k").alias("_key"), F.lit(1).alias("_kind"),
                  F.lit(None).cast(v.schema["_val"].dataType).alias("_val"))
    w = Window.partitionBy(*by, "_chunk").orderBy("_key", "_kind").rowsBetween(_UNBOUNDED, 0)
    merged = v.unionByName(qq).select(*by, "_key", "_kind", F.last("_val", ignorenulls=True).over(w).alias("_v"))
    merged = merged.where(F.col("_kind") == 1)
    y = F.col("_v._y")
    y_next = F.when(F.col("_key") + 1 < F.col("_v.below") + F.col("_v.cnt"), y) \
              .otherwise(F.coalesce(F.col("_v.next_value"), y))
    return merged.select(*by, F.col("_key").alias(k), y.alias("_y"), y_next.alias("_y_next"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | tuple = (),
                    n_buckets: int | None = None, weights: bool = False) -> DataFrame:
    """Exact linearly-interpolated quantiles (pandas ``quantile`` / SQL
    ``percentile_cont``) without collecting a group into one task.

    Returns ``by..., q_index, q, value`` rows (one per group and probability); a null group is a group.
    Interpolation is ``y + (y_next - y) * f``, or with ``weights`` that of Spark's ``percentile``,
    ``y * (1 - f) + y_next * f``; the sizes of the data never change the formula.
    """
    by = list(by)
    if not by and n_buckets is None:
        numbers = quantile_numbers(df, {value: probs}, weights, _small_limit(df))[value]
        rows = [(i, float(q), y) for i, (q, y) in enumerate(zip(probs, numbers, strict=True)) if y is not None]
        return _spark(df).createDataFrame(rows, f"q_index int, q double, `{value}` double")  # one row per probability
    pos = value_positions(df, value, by, n_buckets=n_buckets, with_next=True)
    groups = pos.select(*by, "n").distinct()
    qs = _spark(df).createDataFrame([(i, float(p)) for i, p in enumerate(probs)], "q_index int, q double")
    t = groups.crossJoin(F.broadcast(qs)).withColumn("_p", (F.col("n") - 1) * F.col("q"))  # groups x probs
    t = t.withColumns({"_lo": F.floor("_p").cast("long")}).withColumn("_f", F.col("_p") - F.col("_lo"))
    looked = values_at_positions(pos, value, t, by, "_lo")
    res = null_safe_join(t, looked, [*by, "_lo"])
    between = ((F.col("_lo") + 1 - F.col("_p")) * F.col("_y") + F.col("_f") * F.col("_y_next") if weights
               else F.col("_y") + (F.col("_y_next") - F.col("_y")) * F.col("_f"))
    val = F.when(F.col("_f") == 0, F.col("_y")).otherwise(between)
    return res.select(*by, "q_index", "q", val.alias(value))


def quantiles_wide(df: DataFrame, cols: list[str], probs: list[float],
                   names: dict[tuple[str, int], str] | None = None) -> DataFrame:
    """One row with an exact quantile column per (column, probability); all columns share the passes of
    :func:`quantile_numbers`."""
    names = names or {(c, i): f"{c}__q{i}" for c in cols for i in range(len(probs))}
    numbers = quantile_numbers(df, {c: [float(p) for p in probs] for c in cols}, True, _small_limit(df))
    keys = [(c, i) for c in cols for i in range(len(probs))]
    return _spark(df).createDataFrame([tuple(numbers[c][i] for c, i in keys)], ", ".join(f"`{names[k]}` double" for k in keys))


def median_row(df: DataFrame, cols: list[str], suffix: str = "_median") -> DataFrame:
    """One-row frame of exact medians of several columns."""
    return quantiles_wide(df, cols, [0.5], {(c, 0): c + suffix for c in cols})


def quantile_bins(df: DataFrame, value: str, q: int = 10, out: str = "bin") -> DataFrame:
    """``pd.qcut(x, q, labels=False, duplicates='drop')`` -- exact edges, duplicate
    edges dropped, bin = number of interior edges strictly below the value."""
    numbers = quantile_numbers(df.select(value), {value: [i / q for i in range(q + 1)]}, limit=_small_limit(df))[value]
    edges = sorted({y for y in numbers if y is not None})  # at most q + 1 numbers
    x = F.col(value).cast("double")
    interior = F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<double>")
    return df.withColumn(out, F.when(x.isNotNull(), F.size(F.filter(interior, lambda e: x > e))).cast("int"))


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "rn",
                      n_partitions: int | None = None) -> DataFrame:
    """1-based row number in the total order ``order_cols`` (make it total by
    including a unique key).  Range partition -> sort within partitions ->
    reliable checkpoint -> one count per partition -> offsets."""
    ensure_checkpoint_dir(_spark(df))
    n = n_partitions or int(_spark(df).conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_df = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    # ids are taken before the write, so they do not depend on how the files are read back
    tagged = materialize(sorted_df.withColumn("_mid", F.monotonically_increasing_id()), "row-numbers")
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33))
    counts = {r["_pid"]: r["c"] for r in tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect()}
    offsets, acc = [], 0
    for p in sorted(counts):  # one number per partition: bounded by the partition count
        offsets.append((int(p), acc))
        acc += counts[p]
    off_df = _spark(df).createDataFrame(offsets, "_pid long, _off long")
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), 33)
    tagged = tagged.join(F.broadcast(off_df), "_pid", "inner")  # one row per partition
    rn = F.col("_off") + local + F.lit(1)
    return tagged.withColumn(out, rn).drop("_mid", "_pid", "_off")


def quantile_map(queries: DataFrame, r: str, sample: DataFrame, y: str, out: str = "mapped") -> DataFrame:
    """``np.interp(r, linspace(0, 1, n), sorted(sample.y))`` for every query row.

    ``p = r * (n-1)``; value = y[floor p] + (p - floor p) * (y[floor p + 1] - y[floor p]).
    Sorted-sample lookups go through :func:`value_positions` (distinct values,
    bucketed) and an as-of merge per bucket, so nothing is collected.
    """
    pos = value_positions(sample, y, with_next=True)
    n_row = sample.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).agg(
        F.count(F.lit(1)).alias("_n"))
    q = queries.crossJoin(F.broadcast(n_row))  # one row
    clipped = F.when(F.col(r).isNotNull(), F.least(F.greatest(F.col(r), F.lit(0.0)), F.lit(1.0)))
    p = clipped * (F.col("_n") - 1)
    q = q.withColumns({"_p": p, "_j": F.floor(p).cast("long")})
    # distinct positions only (a hot rank collapses to one lookup), then joined back
    looked = values_at_positions(pos, y, q.where(F.col("_j").isNotNull()), [], "_j")
    res = q.join(looked, "_j", "left")  # a null rank stays, and maps to null
    frac = F.col("_p") - F.col("_j")
    mapped = F.when(frac == 0, F.col("_y")).otherwise(F.col("_y") + frac * (F.col("_y_next") - F.col("_y")))
    return res.select(*queries.columns, mapped.alias(out))


def rolling_mean(df: DataFrame, value: str, partition: list[str], order: list[str],
                 half_width: int = 2, out: str = "rolling_mean", chunk_rows: int | None = 1 << 20) -> DataFrame:
    """Centred rolling mean over ``2*half_width+1`` rows, partial at the edges
    (``rolling(window, center=True, min_periods=1).mean()``).  ``order`` must be a
    total order inside each partition (add a unique key).

    ``chunk_rows=None`` uses a plain window partitioned by ``partition`` (one task
    per key).  Otherwise a hot key is split: rows get a global row number, the
    window is partitioned by (key, row-number chunk), and the ``half_width`` rows
    on each side of a chunk edge are copied into the neighbouring chunk as halo
    rows, so every frame still sees its true neighbours.
    """
    if chunk_rows is None or max_group_size(df, partition) <= chunk_rows:
        # every key measured to fit one window task
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-half_width, half_width)
        return df.withColumn(out, F.avg(value).over(w))
    h = half_width
    numbered = global_row_number(df, [*partition, *order], out="_grn")
    c = F.lit(chunk_rows)
    chunk = F.floor((F.col("_grn") - 1) / c).cast("long")
    offset = F.pmod(F.col("_grn") - 1, c)
    copies = F.array(
        F.struct(chunk.alias("_chunk"), F.lit(False).alias("_halo")),
        F.when(offset < h, F.struct((chunk - 1).alias("_chunk"), F.lit(True).alias("_halo"))),
        F.when(offset >= chunk_rows - h, F.struct((chunk + 1).alias("_chunk"), F.lit(True).alias("_halo"))),
    )
    exploded = numbered.withColumn("_copy", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    exploded = exploded.withColumns({"_chunk": F.col("_copy._chunk"), "_halo": F.col("_copy._halo")}).drop("_copy")
    w = Window.partitionBy(*partition, "_chunk").orderBy("_grn").rowsBetween(-h, h)
    res = exploded.withColumn(out, F.avg(value).over(w)).where(~F.col("_halo"))
    return res.drop("_chunk", "_halo", "_grn")
