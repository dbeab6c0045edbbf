"""Bins by halving equal the count of limits below a value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.functions.bins import bin_column, bin_sql

LIMITS = [[], [2.0], [-1.0, 0.0, 1e-9, 2.0, 2.5, 1e300], [float(k) for k in range(31)], [1.0, float("inf")]]


def test_bins_are_counts_of_limits_below(spark):
    values = [float("-inf"), -1.0, -0.0, 0.0, 1e-9, 1.0, 2.0, 2.25, 30.0, 31.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for limits in LIMITS:
        got = df.select("x", F.expr(bin_sql("x", limits)).alias("s"), bin_column(F.col("x"), limits).alias("c")).collect()
        for r in got:
            want = sum(t < r["x"] or r["x"] != r["x"] for t in limits)
            assert (r["s"], r["c"]) == (want, want), (limits, r)


def test_a_row_meets_few_comparisons():
    def deepest(limits):
        text, depth, most = bin_sql("x", limits), 0, 0
        for piece in text.replace("CAST(", "").split("IF(")[1:]:
            depth += 1
            most = max(most, depth)
            depth -= piece.count(")") - piece.count("AS DOUBLE)")
        return most
    assert deepest([float(k) for k in range(31)]) == 5
