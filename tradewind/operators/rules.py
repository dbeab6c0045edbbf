"""Labels, bands and business rules as column expressions over whole tables.

The reference evaluates its rules with Python ``if`` chains for one entity
on a form. Here each rule is a boolean column; the rules that fire become
rows ``(entity, rule)`` through ``array_compact`` + ``explode``, a narrow
(no-shuffle) projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Band edges, rule thresholds and rule codes.
BAND_HIGH = 70.0
BAND_MEDIUM = 40.0
BULKY_KG = 15.0

STAR_WITHHELD = "rule5_star_withheld"
STAR_CLUSTERS = (0, 3)

CANCEL_LIMIT = 0.15
PRICE_RISE_LIMIT = 30.0
RETURN_LIMIT = 0.10
RATING_DROP_LIMIT = 3
NEWBIE_DAYS = 30
VIP_SPEND = 2000.0


def score_band(score: Column) -> Column:
    """>= 70 high, >= 40 medium, else low."""
    return (F.when(score >= BAND_HIGH, "high").when(score >= BAND_MEDIUM, "medium")
             .otherwise("low"))


def bulky_flags(products: DataFrame) -> DataFrame:
    """Items of 15 kg or more cannot be split into smaller parcels."""
    kg = F.col("product_weight_g") / F.lit(1000.0)
    bulky = F.coalesce(kg >= BULKY_KG, F.lit(False))
    return products.select("product_id", kg.alias("weight_kg"), bulky.alias("is_bulky"),
                           (~bulky).alias("can_split"),
                           F.when(bulky, "bulky_single_piece").otherwise("standard")
                           .alias("handling_category"))


def _fire(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    arr = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))
    return rows.select(key, F.explode(arr).alias("rule"))


def churn_rules(c: DataFrame) -> DataFrame:
    """R5 over a customer table with columns: churn_prob, monetary, frequency,
    avg_review_score, days_since_last, days_since_delivery, fav_category.

    Rules 1 and 2 exclude each other; the others stack.
    """
    p = F.col("churn_prob")
    r1 = (p > 70) & (F.col("monetary") > VIP_SPEND)
    rules = [
        ("rule1_vip", r1),
        ("rule2_comeback", (p > 70) & ~r1),
        ("rule3_survey", (p >= 50) & (p <= 70)),
        ("rule4_missyou", (F.col("frequency") == 1) & (F.col("days_since_last") > 90)),
        ("rule5_refund", F.col("avg_review_score") == 1.0),
        ("rule6_suggest", (F.col("days_since_last") > 60) & F.col("fav_category").isNotNull()),
        ("rule7_review", (F.col("days_since_delivery") == 3) & (F.col("avg_review_score") == 0.0)),
    ]
    return _fire(c, "customer_id", [(k, F.coalesce(v, F.lit(False))) for k, v in rules])


def seller_violation(s: DataFrame) -> Column:
    """Any of the four violations (null inputs count as no violation)."""
    z = lambda c: F.coalesce(c, F.lit(False))
    return (z(F.col("cancellation_rate") > CANCEL_LIMIT) | z(F.col("price_increase_pct") > PRICE_RISE_LIMIT)
            | z(F.col("return_rate") > RETURN_LIMIT) | z(F.col("rating_drop_weeks") >= RATING_DROP_LIMIT))


def seller_rules(s: DataFrame) -> DataFrame:
    """R7 over a seller table with columns: cluster, cancellation_rate,
    price_increase_pct, return_rate, rating_drop_weeks, days_on_platform,
    total_orders. Star sellers who violate get the withheld flag instead."""
    z = lambda c: F.coalesce(c, F.lit(False))
    viol = seller_violation(s)
    star = F.col("cluster").isin(*STAR_CLUSTERS)
    rules = [
        ("rule1_toxic", z(F.col("cancellation_rate") > CANCEL_LIMIT)),
        ("rule2_price", z(F.col("price_increase_pct") > PRICE_RISE_LIMIT)),
        ("rule3_return", z(F.col("return_rate") > RETURN_LIMIT)),
        ("rule4_rating", z(F.col("rating_drop_weeks") >= RATING_DROP_LIMIT)),
        ("rule5_star", z(star & ~viol)),
        (STAR_WITHHELD, z(star & viol)),
        ("rule6_newbie", z((F.col("days_on_platform") < NEWBIE_DAYS) & (F.col("total_orders") == 0))),
    ]
    return _fire(s, "seller_id", rules)


def default_drop_weeks(avg_rating: Column) -> Column:
    """Form default when no weekly history exists."""
    return F.when(avg_rating < 3.0, 3).otherwise(0)
