"""Feature tables for delivery risk, customer churn and seller segments.

Joins follow the reference's SQL (inner joins, review as LEFT JOIN) and keep
its fan-out: item x payment x review rows are joined *before* aggregation,
so sums and means are weighted by that multiplicity. ``dedup_fanout=True``
pre-aggregates each branch to order grain first.

Join order is chosen for the shuffle: all order-grain joins (key order_id)
come first and, on the warehouse tables bucketed by order_id, run without
any exchange; joins on other keys (product_id) come last, but for rows that
are to lie by order (``weigh_first``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.dates import floor_days, frac_days, trunc_days, weekday_mon0, weekday_sun0
from tradewind.functions.money import MONEY, int_avg, money_avg, money_sum
from tradewind.functions.stats import exact_medians, fill_with_median
from tradewind.sources.business import Biz

DELIVERED = "delivered"
MISSING_REVIEW_SCORE = 5
CHURN_AFTER_DAYS = 180
RISK_MAX_REVIEW = 2
MIN_SELLER_ORDERS = 5

RISK_FEATURES = ["product_weight_g", "order_value", "day_of_week", "payment_type"]
CHURN_FEATURES = ["frequency", "monetary", "avg_review_score", "avg_freight_value",
                  "avg_delivery_delay"]
SELLER_FEATURES = ["avg_rating", "total_orders", "avg_delay_days", "cancellation_rate",
                   "avg_order_value"]


# ---------------------------------------------------------------- delivery risk

def risk_base(b: Biz, weigh_first: bool = False) -> DataFrame:
    """Delivered orders x items x payments x products, reviews left-joined.

    The order-grain joins come first: on tables bucketed by order_id they
    need no exchange. The product join comes last: a broadcast when the
    product table is small (AQE measures it), else one shuffle by product_id.
    ``weigh_first``, for rows that are to lie by order: items get their weight
    before they fan out, so only their ids are dealt by product_id and back.
    """
    o = (b.orders.where(F.col("order_status") == DELIVERED)
         .select("order_id", "order_purchase_timestamp", "order_estimated_delivery_date",
                 "order_delivered_customer_date"))
    items, weights = b.items.select("order_id", "product_id"), b.products.select("product_id", "product_weight_g")
    if weigh_first:
        items = items.join(o.select("order_id"), "order_id", "left_semi").join(weights, "product_id").drop("product_id")
    j = (o.join(items, "order_id")
          .join(b.payments.select("order_id", "payment_type", "payment_value"), "order_id")
          .join(b.reviews.select("order_id", "review_score"), "order_id", "left"))
    if not weigh_first:
        j = j.join(weights, "product_id")
    return j.select("order_id", "order_purchase_timestamp", "order_estimated_delivery_date",
                    "order_delivered_customer_date", "payment_type",
                    F.col("payment_value").alias("order_value"), "product_weight_g",
                    "review_score")


def risk_features(b: Biz, table: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Delay (floor days), weekday (Monday = 0), review fill 5, weight fill median, label.
    ``table`` writes the rows, which lie by order, before the passes of the median."""
    base = risk_base(b, weigh_first=table is not None)
    f = base.select(
        "order_id", "payment_type", "order_value", "product_weight_g",
        floor_days("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("delivery_delay_days"),
        weekday_mon0("order_purchase_timestamp").alias("day_of_week"),
        F.coalesce(F.col("review_score"), F.lit(MISSING_REVIEW_SCORE)).alias("review_score"),
    )
    f = f.withColumn("is_risk", risk_label_expr())
    return fill_with_median(table(f) if table else f, ["product_weight_g"])


def risk_label_expr() -> F.Column:
    # null delay compares false, like NaN > 0 in pandas
    late = F.coalesce(F.col("delivery_delay_days") > 0, F.lit(False))
    return F.when(late & (F.col("review_score") <= RISK_MAX_REVIEW), 1).otherwise(0)


def risk_label(b: Biz) -> DataFrame:
    """One row per delivered order: delay, filled review, label."""
    return (risk_features(b).select("order_id", "delivery_delay_days", "review_score", "is_risk")
            .distinct())


# ---------------------------------------------------------------- churn

def _churn_aggregate(b: Biz, delivered_only: bool = True) -> DataFrame:
    o = b.orders
    if delivered_only:
        o = o.where(F.col("order_status") == DELIVERED)
    o = o.select("order_id", "customer_id", "order_purchase_timestamp",
                 trunc_days("order_delivered_customer_date", "order_estimated_delivery_date")
                 .alias("delay_days"))
    j = (o.join(b.payments.select("order_id", "payment_value"), "order_id")
          .join(b.items.select("order_id", "freight_value"), "order_id")
          .join(b.reviews.select("order_id", "review_score"), "order_id", "left"))
    # Pre-aggregate the fan-out rows to (customer, order) grain. The joins
    # left the rows hash-partitioned by order_id, which already clusters
    # (customer_id, order_id): this step adds no shuffle, and the customer
    # level below shuffles order-grain rows with plain counts (no Expand of
    # the fan-out rows for the distinct count). Sums are decimal and means
    # are sum / count, so the result equals the one-step aggregate.
    per_order = j.groupBy("customer_id", "order_id").agg(
        F.max("order_purchase_timestamp").alias("last_ts"),
        F.sum(F.col("payment_value").cast(MONEY)).alias("pay"),
        F.sum(F.col("review_score").cast("bigint")).alias("rv_sum"), F.count("review_score").alias("rv_n"),
        F.sum(F.col("freight_value").cast(MONEY)).alias("fr_sum"), F.count("freight_value").alias("fr_n"),
        F.sum(F.col("delay_days").cast("bigint")).alias("dl_sum"), F.count("delay_days").alias("dl_n"))
    return per_order.groupBy("customer_id").agg(
        F.max("last_ts").alias("last_purchase_date"),
        F.count("order_id").alias("frequency"),
        F.sum("pay").cast("double").alias("monetary"),
        F.try_divide(F.sum("rv_sum").cast("double"), F.sum("rv_n")).alias("avg_review_score"),
        F.try_divide(F.sum("fr_sum").cast("double"), F.sum("fr_n")).alias("avg_freight_value"),
        F.try_divide(F.sum("dl_sum").cast("double"), F.sum("dl_n")).alias("avg_delivery_delay"),
    )


def _churn_aggregate_dedup(b: Biz) -> DataFrame:
    """Each branch reduced to one row per order before the order-grain join."""
    o = (b.orders.where(F.col("order_status") == DELIVERED)
         .select("order_id", "customer_id", "order_purchase_timestamp",
                 trunc_days("order_delivered_customer_date", "order_estimated_delivery_date")
                 .alias("delay_days")))
    pay = b.payments.groupBy("order_id").agg(F.sum(F.col("payment_value").cast(MONEY)).alias("pay"))
    itm = b.items.groupBy("order_id").agg(F.sum(F.col("freight_value").cast(MONEY)).alias("fr_sum"),
                                         F.count("freight_value").alias("fr_n"))
    rev = b.reviews.groupBy("order_id").agg(F.sum(F.col("review_score").cast("bigint")).alias("rv_sum"),
                                           F.count("review_score").alias("rv_n"))
    j = o.join(pay, "order_id").join(itm, "order_id").join(rev, "order_id", "left")
    return j.groupBy("customer_id").agg(
        F.max("order_purchase_timestamp").alias("last_purchase_date"),
        F.count("order_id").alias("frequency"),
        F.sum("pay").cast("double").alias("monetary"),
        F.try_divide(F.sum("rv_sum").cast("double"), F.sum("rv_n")).alias("avg_review_score"),
        F.try_divide(F.sum("fr_sum").cast("double"), F.sum("fr_n")).alias("avg_freight_value"),
        int_avg("delay_days").alias("avg_delivery_delay"),
    )


def materialize(df: DataFrame) -> DataFrame:
    """Write a reused intermediate to the shared checkpoint folder.

    A reliable checkpoint (not a local one) so a lost executor does not
    force the joins behind it to run again for every later pass.
    """
    return df.checkpoint(eager=True)


def churn_features(b: Biz, dedup_fanout: bool = False) -> DataFrame:
    agg = _churn_aggregate_dedup(b) if dedup_fanout else _churn_aggregate(b)
    agg = materialize(agg)
    agg = fill_with_median(agg, ["avg_review_score", "avg_delivery_delay", "avg_freight_value"])
    # Newest purchase of all customers as a scalar subquery: a distributed
    # max, one value broadcast to every task.
    newest = agg.select(F.max("last_purchase_date")).scalar()
    out = agg.withColumn("recency_days", floor_days(newest, F.col("last_purchase_date")))
    return out.withColumn("is_churn", churn_label_expr())


def churn_label_expr() -> F.Column:
    return F.when(F.col("recency_days") > CHURN_AFTER_DAYS, 1).otherwise(0)


def churn_label(b: Biz) -> DataFrame:
    return churn_features(b).select("customer_id", "recency_days", "is_churn")


# ---------------------------------------------------------------- sellers

def seller_order_facts(b: Biz) -> DataFrame:
    """One row per (seller, order): the grain every seller measure needs.

    Items are summed per (seller, order) right after the bucketed order join
    (no exchange), reviews per order, and the two are joined on order_id
    (still no exchange). ``w`` is the number of rows the reference's
    ``items JOIN orders LEFT JOIN reviews`` produces per item of the order
    (max(1, review rows)), so fan-out weighted means stay exact:
    sum(x * lines * w) / sum(lines * w).
    """
    o = b.orders.select("order_id", "order_status", "order_purchase_timestamp",
                        F.date_trunc("week", "order_purchase_timestamp").cast("date").alias("week"),
                        frac_days("order_delivered_customer_date", "order_estimated_delivery_date")
                        .alias("delay_days"))
    per = (b.items.select("order_id", "seller_id", "price", "is_returned").join(o, "order_id")
           .groupBy("seller_id", "order_id").agg(
               F.first("order_status").alias("order_status"),
               F.first("order_purchase_timestamp").alias("purchase_ts"),
               F.first("week").alias("week"), F.first("delay_days").alias("delay_days"),
               F.count("*").alias("lines"),
               F.sum(F.col("price").cast(MONEY)).alias("price_sum"), F.count("price").alias("price_n"),
               F.sum(F.col("is_returned").cast("int")).alias("returned")))
    rv = b.reviews.groupBy("order_id").agg(F.sum(F.col("review_score").cast("bigint")).alias("rv_sum"),
                                          F.count("review_score").alias("rv_n"),
                                          F.count("*").alias("rv_rows"))
    return (per.join(rv, "order_id", "left")
               .select("*", F.greatest(F.coalesce("rv_rows", F.lit(0)), F.lit(1)).alias("w")))


def seller_aggregate(b: Biz, for_serving: bool = False, facts: DataFrame | None = None) -> DataFrame:
    """Per-seller means, distinct orders and cancellation ratio,
    weighted like the reference's fan-out join (see seller_order_facts)."""
    f = facts if facts is not None else seller_order_facts(b)
    lw = F.col("lines") * F.col("w")
    canceled = F.when(F.col("order_status") == "canceled", 1).otherwise(0)
    agg = f.groupBy("seller_id").agg(
        F.count("order_id").alias("total_orders"),
        F.try_divide(F.sum(F.col("price_sum") * F.col("w")).cast("double"),
                     F.sum(F.col("price_n") * F.col("w"))).alias("avg_order_value"),
        F.try_divide(F.sum(F.col("lines") * F.coalesce("rv_sum", F.lit(0))).cast("double"),
                     F.sum(F.col("lines") * F.coalesce("rv_n", F.lit(0)))).alias("avg_rating"),
        F.try_divide(F.sum(F.col("delay_days") * lw),
                     F.sum(F.when(F.col("delay_days").isNotNull(), lw))).alias("avg_delay_days"),
        F.try_divide(F.sum(canceled * lw).cast("double"), F.sum(lw)).alias("cancellation_rate"),
    )
    if not for_serving:
        agg = agg.where(F.col("total_orders") > MIN_SELLER_ORDERS)
    return agg


def seller_features(b: Biz) -> DataFrame:
    agg = materialize(seller_aggregate(b))
    agg = fill_with_median(agg, ["avg_order_value", "avg_rating", "avg_delay_days",
                                 "cancellation_rate"])
    return agg.withColumn("revenue_estimate",
                          F.col("total_orders").cast("double") * F.col("avg_order_value"))


# ---------------------------------------------------------------- medians / day rules

def feature_medians(b: Biz, spark) -> DataFrame:
    """Interpolated medians of every median-filled feature column.

    Each median is a distributed two-pass job (see ``exact_median``); the
    result is one small row per (table, feature).
    """
    risk = materialize(risk_base(b).select("product_weight_g"))
    churn = materialize(_churn_aggregate(b))
    seller = materialize(seller_aggregate(b))
    rows = []
    plan = [("risk", risk, ["product_weight_g"]),
            ("churn", churn, ["avg_review_score", "avg_delivery_delay", "avg_freight_value"]),
            ("seller", seller, ["avg_rating", "total_orders", "avg_delay_days", "cancellation_rate",
                                "avg_order_value"])]
    for table, df, cols in plan:
        meds = exact_medians(df, cols)  # two passes per table for all its columns
        rows += [(table, c, meds[c]) for c in cols]
    return spark.createDataFrame(rows, "feature_table string, feature string, median double")


def delay_three_ways(b: Biz) -> DataFrame:
    o = b.orders.where(F.col("order_delivered_customer_date").isNotNull())
    a, e = "order_delivered_customer_date", "order_estimated_delivery_date"
    return o.select("order_id", floor_days(a, e).alias("delay_floor"),
                    trunc_days(a, e).alias("delay_trunc"), frac_days(a, e).alias("delay_frac"))


def weekday_skew(b: Biz) -> DataFrame:
    o = b.orders_nodates
    ts = "order_purchase_timestamp"
    return o.select("order_id", weekday_mon0(ts).alias("weekday_training"),
                    weekday_sun0(ts).alias("weekday_serving"),
                    (weekday_mon0(ts) != weekday_sun0(ts)).alias("skewed"))
