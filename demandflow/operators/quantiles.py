"""Exact quantiles of whole columns by bracket and count.

A quantile is the value at one or two ranks of the sorted column.  For every wanted rank a bracket of values is kept that holds it,
with the exact number of rows below and inside.  While a bracket holds more than ``INSIDE_ROWS`` rows, a sketch of its inside
proposes a narrower one around each rank (a sketch's rank error is a fixed share of the rows, so a bracket loses all but some
ten-thousandth of them) and one exact pass counts; a proposal that misses its rank is not taken.  What is left inside is collapsed to
distinct values with their numbers and scanned in order, a bracket at a time.  All columns and probabilities share each pass, nothing but counts,
bracket ends and the values at the wanted ranks reaches the driver, and small and large columns go the same way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bracket may hold when its values are scanned
INSIDE_ROWS = 1_000_000
#: Accuracy of the sketches (a rank's error is at most the rows divided by this)
ACCURACY = 20_000


@dataclass
class Bracket:
    """Values from lo to hi (None: no end) of a column, both included; ``below`` rows are smaller than lo, ``inside`` are in it."""

    column: str
    lo: float | None
    hi: float | None
    below: int
    inside: int
    ranks: list

    def holds(self, x: Column) -> Column:
        c = x.isNotNull()
        if self.lo is not None:
            c = c & (x >= F.lit(self.lo))
        return c if self.hi is None else c & (x <= F.lit(self.hi))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles; NaN counts as missing."""
    def one(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x).alias(c)

    return df.select(*[one(c) for c in columns])


def _proposals(b: Bracket, sketch: list[float], shares: list[float]) -> list[Bracket]:
    """Narrower brackets around b's ranks from the sketched ends (two per rank); overlapping ones are one."""
    ends = []
    for i, r in enumerate(b.ranks):
        lo, hi = sketch[2 * i], sketch[2 * i + 1]
        ends.append((b.lo if shares[2 * i] <= 0 else lo, b.hi if shares[2 * i + 1] >= 1 else hi, r))
    out: list[Bracket] = []
    for lo, hi, r in sorted(ends, key=lambda e: e[2]):
        last = out[-1] if out else None
        if last is not None and (last.hi is None or lo is None or lo <= last.hi):
            last.hi = None if hi is None or last.hi is None else max(hi, last.hi)
            last.ranks.append(r)
        else:
            out.append(Bracket(b.column, lo, hi, 0, 0, [r]))
    return out


def narrow(values: DataFrame, brackets: list[Bracket], accuracy: int = ACCURACY) -> list[Bracket]:
    """One round for brackets that are too wide: sketch the inside, count the proposals, take those that hold their ranks and
    at most half of the rows; a rank without such a proposal keeps its bracket."""
    error = 2.0 / accuracy
    shares = []
    for b in brackets:
        at = [(r - b.below + 0.5) / b.inside for r in b.ranks]
        shares.append([s for f in at for s in (max(0.0, f - error), min(1.0, f + error))])
    row = values.agg(*[F.percentile_approx(F.when(b.holds(F.col(b.column)), F.col(b.column)), s, accuracy).alias(f"s{i}")
                       for i, (b, s) in enumerate(zip(brackets, shares, strict=True))]).first()
    proposed = [(b, p) for i, b in enumerate(brackets) for p in _proposals(b, row[f"s{i}"], shares[i])]
    counts = values.agg(*[e for i, (_, p) in enumerate(proposed) for e in (
        (F.count_if(F.col(p.column) < F.lit(p.lo)) if p.lo is not None else F.lit(0).cast("long")).alias(f"b{i}"), F.count_if(p.holds(F.col(p.column))).alias(f"n{i}"))]).first()
    out = []
    for i, (b, p) in enumerate(proposed):
        p.below, p.inside = int(counts[f"b{i}"]), int(counts[f"n{i}"])
        good = [r for r in p.ranks if p.below <= r < p.below + p.inside] if p.inside * 2 <= b.inside or p.lo == p.hi else []
        if good:
            out.append(Bracket(p.column, p.lo, p.hi, p.below, p.inside, good))
        if rest := [r for r in p.ranks if r not in good]:
            out.append(Bracket(b.column, b.lo, b.hi, b.below, b.inside, rest))
    return out


def values_at_ranks(df: DataFrame, ranks_of, columns: list[str], limit: int = INSIDE_ROWS, accuracy: int = ACCURACY) -> tuple[dict, dict]:
    """({column: rows that are not missing}, {(column, rank): value}) for the ranks (from 0) that ``ranks_of(column, rows)`` names."""
    values = _values(df, columns)
    row = values.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    n = {c: int(row[f"n{i}"]) for i, c in enumerate(columns)}
    open_ = [Bracket(c, None, None, 0, n[c], sorted(set(ranks_of(c, n[c])))) for c in columns if n[c]]
    ready = []
    while open_:
        ready += [b for b in open_ if b.inside <= limit or b.lo is not None and b.lo == b.hi]
        wide = [b for b in open_ if b.inside > limit and not (b.lo is not None and b.lo == b.hi)]
        if not wide:
            break
        before = {(b.column, r): b.inside for b in wide for r in b.ranks}
        open_ = narrow(values, wide, accuracy)
        stuck = [b for b in open_ if all(before[(b.column, r)] == b.inside for r in b.ranks)]
        ready += stuck  # no sketch parts them further: scanned as they are
        open_ = [b for b in open_ if b not in stuck]
    found = {(b.column, r): b.lo for b in ready for r in b.ranks if b.lo is not None and b.lo == b.hi}
    scan = [b for b in ready if not (b.lo is not None and b.lo == b.hi)]
    if scan:
        entries = F.array(*[F.when(b.holds(F.col(b.column)), F.struct(F.lit(i).alias("b"), F.col(b.column).alias("v"))) for i, b in enumerate(scan)])
        per = values.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy("e.b", "e.v").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        wanted = F.create_map(*[x for i, b in enumerate(scan) for x in (F.lit(i), F.array(*[F.lit(r - b.below) for r in b.ranks]))])
        hits = per.withColumn("u", upto).withColumn("r", F.filter(wanted[F.col("b")], lambda r: (r < F.col("u")) & (r >= F.col("u") - F.col("c"))))
        for h in hits.where(F.size("r") > 0).select("b", "v", "r").collect():  # at most one row per wanted rank
            found.update({(scan[h.b].column, r + scan[h.b].below): h.v for r in h.r})
    return n, found


def quantile_numbers(df: DataFrame, wanted: dict[str, list[float]], weights: bool = False, limit: int = INSIDE_ROWS, accuracy: int = ACCURACY) -> dict[str, list]:
    """{column: its exact quantiles, linearly interpolated} (None where a column has no values).

    Interpolation is ``y + (y_next - y) * f``, or with ``weights`` that of Spark's ``percentile``, ``y * (1 - f) + y_next * f``."""
    def places(c, n):
        return [((n - 1) * q, math.floor((n - 1) * q)) for q in wanted[c]]

    n, at = values_at_ranks(df, lambda c, n: [k for p, lo in places(c, n) for k in ((lo,) if p == lo else (lo, lo + 1))], list(wanted), limit, accuracy)
    out = {}
    for c in wanted:
        out[c] = [None] * len(wanted[c])
        for i, (p, lo) in enumerate(places(c, n[c]) if n[c] else []):
            y, f = at[(c, lo)], p - lo
            if f:
                after = at[(c, lo + 1)]
                y = (lo + 1 - p) * y + f * after if weights else y + (after - y) * f
            out[c][i] = y
    return out
