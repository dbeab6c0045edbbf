"""Rule inputs the reference's forms ask a person for, derived from tables.

All windows here are partitioned by entity and run on already aggregated
rows (one per entity-week or entity-category), so even a seller holding a
third of all items contributes only a few hundred rows to its window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.dates import floor_days
from tradewind.sources.business import Biz


def as_of(b: Biz) -> F.Column:
    """The newest purchase time of all orders, as a scalar subquery."""
    return b.orders_nodates.select(F.max("order_purchase_timestamp")).scalar()


def favourite_category(b: Biz) -> DataFrame:
    """D3: most bought category per customer; ties go to the smaller name."""
    cnt = (b.orders_nodates.select("order_id", "customer_id")
           .join(b.items.select("order_id", "product_id"), "order_id")
           .join(b.products.select("product_id",
                                   F.trim("product_category_name").alias("category")), "product_id")
           .groupBy("customer_id", "category").agg(F.count("*").alias("n")))
    w = Window.partitionBy("customer_id").orderBy(F.col("n").desc(), F.col("category").asc())
    return (cnt.withColumn("rn", F.row_number().over(w)).where("rn = 1")
               .select("customer_id", F.col("category").alias("fav_category")))


def customer_inputs(b: Biz) -> DataFrame:
    """Days since last purchase and delivery, favourite category."""
    now = as_of(b)
    last = b.orders.groupBy("customer_id").agg(
        F.max("order_purchase_timestamp").alias("last_purchase"),
        F.max("order_delivered_customer_date").alias("last_delivery"))
    return (last.join(favourite_category(b), "customer_id", "left")
                .select("customer_id",
                        floor_days(now, F.col("last_purchase")).alias("days_since_last"),
                        floor_days(now, F.col("last_delivery")).alias("days_since_delivery"),
                        "fav_category"))


def _facts(b: Biz, facts: DataFrame | None) -> DataFrame:
    from tradewind.operators.features import seller_order_facts
    return facts if facts is not None else seller_order_facts(b)


def rating_drop_weeks(b: Biz, facts: DataFrame | None = None) -> DataFrame:
    """Length of the run of week-over-week rating drops ending at the
    seller's newest week (gaps-and-islands on weekly means). Weekly means
    are over item x review rows, from the (seller, order) facts."""
    f = _facts(b, facts)
    wk = (f.groupBy("seller_id", "week")
           .agg(F.sum(F.col("lines") * F.coalesce("rv_sum", F.lit(0))).alias("s"),
                F.sum(F.col("lines") * F.coalesce("rv_n", F.lit(0))).alias("n"),
                F.sum(F.col("lines") * F.coalesce("rv_rows", F.lit(0))).alias("rows"))
           .where(F.col("rows") > 0)  # weeks with at least one reviewed order
           .select("seller_id", "week", F.try_divide(F.col("s").cast("double"), F.col("n")).alias("avg_rating")))
    w = Window.partitionBy("seller_id").orderBy("week")
    s = (wk.withColumn("idx", F.row_number().over(w))
           .withColumn("drop", F.coalesce(F.col("avg_rating") < F.lag("avg_rating").over(w),
                                          F.lit(False))))
    return s.groupBy("seller_id").agg(
        (F.max("idx") - F.max(F.when(~F.col("drop"), F.col("idx")))).alias("rating_drop_weeks"),
        F.max("week").alias("last_week"))


def price_increase(b: Biz, facts: DataFrame | None = None) -> DataFrame:
    """% change of mean item price, newest week against the week before."""
    f = _facts(b, facts)
    wk = f.groupBy("seller_id", "week").agg(
        F.try_divide(F.sum("price_sum").cast("double"), F.sum("price_n")).alias("avg_price"))
    w = Window.partitionBy("seller_id").orderBy(F.col("week").desc())
    r = wk.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    g = r.groupBy("seller_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("week"))).alias("last_week"),
        F.max(F.when(F.col("rn") == 1, F.col("avg_price"))).alias("p1"),
        F.max(F.when(F.col("rn") == 2, F.col("avg_price"))).alias("p2"))
    return g.select("seller_id", "last_week",
                    (F.try_divide(F.col("p1") - F.col("p2"), F.col("p2")) * F.lit(100.0))
                    .alias("price_increase_pct"))


def seller_inputs(b: Biz, facts: DataFrame | None = None) -> DataFrame:
    """D6, D7 over every seller, including sellers without any order."""
    now = as_of(b)
    act = _facts(b, facts).groupBy("seller_id").agg(
        F.min("purchase_ts").alias("first_order"),
        F.count("order_id").alias("total_orders"),
        F.try_divide(F.sum("returned").cast("double"), F.sum("lines")).alias("return_rate"))
    return (b.sellers.select("seller_id").join(act, "seller_id", "left")
            .select("seller_id",
                    F.coalesce(floor_days(now, F.col("first_order")), F.lit(0)).alias("days_on_platform"),
                    F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
                    F.coalesce("return_rate", F.lit(0.0)).alias("return_rate")))
