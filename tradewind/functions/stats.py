"""Exact statistics that stay distributed.

``F.median`` / ``percentile`` merge every distinct value into one task for a
global median. ``exact_medians`` narrows an open interval instead. Each round is
two aggregate passes for all columns together:

1. a small quantile sketch (``ACCURACY``) of the values inside the interval
   gives two values around the rank that is looked for;
2. the counts below, at and between the two either settle the rank (it falls on
   one of them, as it does with heavy ties) or give a smaller open interval.

An interval shrinks by the sketch's accuracy in a round and always loses its two
ends. Only scalars reach the driver, whatever the ties. The result equals
pandas' / SQL's interpolated median exactly: ``lo + (hi - lo) * 0.5`` for an
even count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


class _Rank:
    """Search for the value at rank ``k`` (from 0) in the open interval (lo, hi)."""

    def __init__(self, column, k: int, n: int):
        self.column, self.k, self.lo, self.hi = column, k, None, None
        self.below, self.inside, self.value = 0, n, None

    def values(self):
        v = self.column
        for bound, op in ((self.lo, "__gt__"), (self.hi, "__lt__")):
            if bound is not None:
                v = F.when(getattr(self.column, op)(bound) & v.isNotNull(), v)
        return v

    def probes(self, accuracy: int):
        at, margin = (self.k - self.below + 0.5) / self.inside, 2.0 / accuracy
        return F.percentile_approx(self.values(), [max(0.0, at - margin), min(1.0, at + margin)], accuracy)

    def counts(self, p, q):
        v = self.values()
        return [F.count_if(v < p), F.count_if(v == p), F.count_if((v > p) & (v < q)), F.count_if(v == q)]

    def narrow(self, p, q, under, at_p, between, at_q):
        r = self.k - self.below
        if r < under:
            self.hi, self.inside = p, under
        elif r < under + at_p:
            self.value = p
        elif p == q or r >= under + at_p + between + at_q:
            beyond = under + at_p + (0 if p == q else between + at_q)
            self.lo, self.below, self.inside = q, self.below + beyond, self.inside - beyond
        elif r < under + at_p + between:
            self.lo, self.hi, self.below, self.inside = p, q, self.below + under + at_p, between
        else:
            self.value = q


def exact_medians(df: DataFrame, columns: list[str], accuracy: int = ACCURACY) -> dict[str, float | None]:
    """The interpolated median of each column (nulls and NaN skipped; None without values)."""
    if not columns:
        return {}
    vals = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    n = df.agg(*[F.count(vals[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    ranks = {(c, k): _Rank(vals[c], k, n[i]) for i, c in enumerate(columns) if n[i]
             for k in {(n[i] - 1) // 2, n[i] // 2}}
    while todo := [r for r in ranks.values() if r.value is None]:
        bounds = df.agg(*[r.probes(accuracy).alias(f"b{i}") for i, r in enumerate(todo)]).first()
        got = df.agg(*[x.alias(f"c{i}_{j}") for i, r in enumerate(todo)
                       for j, x in enumerate(r.counts(*bounds[i]))]).first()
        for i, r in enumerate(todo):
            r.narrow(*bounds[i], *[got[f"c{i}_{j}"] for j in range(4)])
    out: dict[str, float | None] = dict.fromkeys(columns)
    for i, c in enumerate(columns):
        if n[i]:
            a, b = ranks[c, (n[i] - 1) // 2].value, ranks[c, n[i] // 2].value
            out[c] = a if n[i] % 2 else a + (b - a) * 0.5
    return out


def exact_median(df: DataFrame, column: str, accuracy: int = ACCURACY) -> float | None:
    return exact_medians(df, [column], accuracy)[column]


def fill_with_median(df: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """``fillna(median)`` per column; medians only for columns that have nulls
    (one pass to count nulls, then a few passes for all medians together)."""
    source = source if source is not None else df
    null_counts = source.agg(*[F.count(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1))
                               .alias(c) for c in columns]).first()
    need = [c for c in columns if null_counts[c]]
    meds = exact_medians(source, need)
    out = df
    for c in need:
        m = meds.get(c)
        if m is not None:
            out = out.withColumn(c, F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")),
                                           F.lit(m).cast(df.schema[c].dataType))
                                 .otherwise(F.col(c)))
    return out
