"""Blending and selection over aligned prediction columns.

Weight search never rescans the rows per candidate: one aggregate produces
the k x k moment matrix (sums of y*y, p_i*y, p_i*p_j, ...) and every lattice
point is scored from those moments (``R^2(w) = 1 - (Syy - 2 w.b + w'Gw) / SST``).
Only the moments (O(k^2) numbers) are ever pulled to the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandflow.operators.order import average_rank, plan_buckets, quantile_map


def rank_scores(scores: DataFrame, score: str, name: str, flag: str = "is_best") -> DataFrame:
    """Mark the best row of a small score table (ties -> smallest name).
    The score table has one row per variant (bounded), so an un-partitioned
    window is fine here."""
    w = Window.orderBy(F.col(score).desc_nulls_last(), F.col(name))
    return scores.withColumn(flag, (F.row_number().over(w) == 1).cast("int"))


def blend_equal(df: DataFrame, cols: list[str], out: str = "blend") -> DataFrame:
    """B1: equal-weight average of k aligned predictions."""
    total = None
    for c in cols:
        total = F.col(c) if total is None else total + F.col(c)
    return df.withColumn(out, total / F.lit(float(len(cols))))


def blend_moments(df: DataFrame, y: str, cols: list[str]) -> DataFrame:
    """One-row moments: n, Sy, Syy, var_pop(y), S p_i y, S p_i p_j (i <= j)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"),
            F.var_pop(y).alias("vy")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(F.col(a) * F.col(y)).alias(f"b_{i}"))
        for j in range(i, len(cols)):
            aggs.append(F.sum(F.col(a) * F.col(cols[j])).alias(f"g_{i}_{j}"))
    return df.agg(*aggs)


def _r2_from_moments(ws, k):
    """Column expression of R^2 for weights ``ws`` (Columns) over a moments row."""
    lin = None
    for i in range(k):
        t = ws[i] * F.col(f"b_{i}")
        lin = t if lin is None else lin + t
    quad = None
    for i in range(k):
        for j in range(k):
            g = F.col(f"g_{min(i, j)}_{max(i, j)}")
            t = ws[i] * ws[j] * g
            quad = t if quad is None else quad + t
    sse = F.col("syy") - F.lit(2.0) * lin + quad
    sst = F.col("vy") * F.col("n")
    return F.when(sst == 0, F.when(sse <= 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) - sse / sst)


def blend_grid(df: DataFrame, y: str, cols: list[str], steps: int = 21) -> DataFrame:
    """B2: every weight vector on the simplex lattice with ``steps - 1`` divisions,
    scored from one moments aggregate.  Returns all lattice points with ``r2``
    and ``score``; ``is_best`` marks max raw R^2 (ties: lattice order)."""
    spark = df.sparkSession
    k = len(cols)
    m = steps - 1
    lattice = spark.range(steps).select(F.col("id").cast("int").alias("i0"))
    for i in range(1, k - 1):
        lattice = lattice.crossJoin(spark.range(steps).select(F.col("id").cast("int").alias(f"i{i}")))
    free = [F.col(f"i{i}") for i in range(k - 1)]
    used = None
    for c in free:
        used = c if used is None else used + c
    lattice = lattice.withColumn(f"i{k - 1}", F.lit(m) - used).where(F.col(f"i{k - 1}") >= 0)
    moments = blend_moments(df, y, cols)
    pts = lattice.crossJoin(F.broadcast(moments))  # one-row moments: proven size
    ws = [F.col(f"i{i}") / F.lit(float(m)) for i in range(k)]
    pts = pts.select(*[w.alias(f"w_{c}") for w, c in zip(ws, cols)], *[F.col(f"i{i}") for i in range(k)],
                     _r2_from_moments(ws, k).alias("r2"))
    pts = pts.withColumn("score", F.greatest(F.lit(0.0), F.lit(100.0) * F.col("r2")))
    # the lattice is bounded by the parameters (C(steps+k-2, k-1) points)
    w = Window.orderBy(F.col("r2").desc(), *[F.col(f"i{i}") for i in range(k)])
    return pts.withColumn("is_best", (F.row_number().over(w) == 1).cast("int")).drop(*[f"i{i}" for i in range(k)])


def blend_optimal(df: DataFrame, y: str, cols: list[str]) -> dict:
    """Exact simplex-constrained least-squares weights (maximise R^2).

    Solves the KKT system of every face of the simplex from the k x k moments
    on the driver (k <= ~10, 2^k faces) and keeps the feasible face with the
    smallest SSE.  Returns ``{"weights": {...}, "r2": ...}``.
    """
    k = len(cols)
    row = blend_moments(df, y, cols).first()
    G = np.zeros((k, k))
    b = np.zeros(k)
    for i in range(k):
        b[i] = row[f"b_{i}"]
        for j in range(i, k):
            G[i, j] = G[j, i] = row[f"g_{i}_{j}"]
    syy, sst = row["syy"], row["vy"] * row["n"]
    best = None
    for size in range(1, k + 1):
        for face in itertools.combinations(range(k), size):
            idx = list(face)
            A = np.zeros((size + 1, size + 1))
            A[:size, :size] = G[np.ix_(idx, idx)]
            A[:size, size] = 1.0
            A[size, :size] = 1.0
            rhs = np.concatenate([b[idx], [1.0]])
            try:
                sol = np.linalg.solve(A, rhs)
            except np.linalg.LinAlgError:
                sol = np.linalg.lstsq(A, rhs, rcond=None)[0]
            w = np.zeros(k)
            w[idx] = sol[:size]
            if (w < -1e-12).any():
                continue
            w = np.clip(w, 0.0, None)
            w = w / w.sum()
            sse = syy - 2 * w @ b + w @ G @ w
            if best is None or sse < best[0] - 1e-15:
                best = (sse, w)
    sse, w = best
    r2 = (1.0 if sse <= 0 else 0.0) if sst == 0 else 1.0 - sse / sst
    return {"weights": {c: float(v) for c, v in zip(cols, w)}, "r2": float(r2)}


def blend_rank(df: DataFrame, cols: list[str], key: str, sample: DataFrame, y: str,
               out: str = "rank_blend") -> DataFrame:
    """Mean of the scaled average ranks of every prediction, mapped onto the
    sorted ``sample.y`` by linear interpolation (W2 + W5)."""
    base = df.select(key, *cols)
    nb = plan_buckets(base, cols)
    ranked = None
    for c in cols:
        r = average_rank(base.select(key, c), c, out=f"_r_{c}", scaled=True, n_buckets=nb[c]).select(key, f"_r_{c}")
        ranked = r if ranked is None else ranked.join(r, key)
    mean_rank = None
    for c in cols:
        mean_rank = F.col(f"_r_{c}") if mean_rank is None else mean_rank + F.col(f"_r_{c}")
    q = ranked.select(key, (mean_rank / F.lit(float(len(cols)))).alias("_mr"))
    return quantile_map(q, "_mr", sample, y, out=out).drop("_mr")


def blend_apply(long_preds: DataFrame, weights: DataFrame, key: str = "idx", model: str = "model",
                pred: str = "pred", weight: str = "weight", out: str = "blend") -> DataFrame:
    """Weights table (one row per model: bounded) joined on the model name,
    ``sum(weight * pred)`` by row id."""
    j = long_preds.join(F.broadcast(weights), on=model, how="inner")
    return j.groupBy(key).agg(F.sum(F.col(weight) * F.col(pred)).alias(out))


def to_long(df: DataFrame, key: str, cols: list[str], model: str = "model", pred: str = "pred") -> DataFrame:
    """Wide prediction columns -> long ``key, model, pred``."""
    return df.unpivot([key], cols, model, pred)


def align(long_preds: DataFrame, key: str, models: list[str], model: str = "model",
          pred: str = "pred") -> DataFrame:
    """IO2 / J9: long predictions of k models lined up by row id (pivot with the
    model list given, so no extra pass to discover the levels)."""
    return long_preds.groupBy(key).pivot(model, models).agg(F.first(pred))


def softmax_allocation(scores: DataFrame, score: str, budget: int, out: str = "trials") -> DataFrame:
    """``floor(budget * softmax(score))`` over a small table of study scores."""
    w = Window.partitionBy()  # one row per study: bounded
    e = scores.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn("share", F.col("_e") / F.sum("_e").over(w)).drop("_e") \
            .withColumn(out, F.floor(F.lit(float(budget)) * F.col("share")).cast("int"))
