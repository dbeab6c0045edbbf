"""Dashboard KPIs, monthly trends and charts.

All measures are grouped aggregates (partial aggregation before the
shuffle). Windows without a partition key run only on already aggregated,
bounded results (one row per month or per status).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.dates import month_label
from tradewind.functions.money import MONEY, money_sum
from tradewind.functions.text import category_label

BRL_TO_VND = 4500.0
MILLION = 1000000.0


def kpi_totals(payments: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Headline numbers as (metric, value) rows: revenue, orders, customers.

    Each is a global aggregate (partial per task, one tiny final merge);
    the three are stacked with a union, so no join is needed.
    """
    rev = payments.agg(money_sum("payment_value").alias("value"))
    return (rev.select(F.lit("total_revenue").alias("metric"), "value")
            .unionByName(rev.select(F.lit("total_revenue_vnd").alias("metric"),
                                    (F.col("value") * F.lit(BRL_TO_VND)).alias("value")))
            .unionByName(orders.agg(F.count("order_id").cast("double").alias("value"))
                         .select(F.lit("total_orders").alias("metric"), "value"))
            .unionByName(customers.agg(F.count_distinct("customer_unique_id").cast("double")
                                       .alias("value"))
                         .select(F.lit("total_customers").alias("metric"), "value")))


def _delivered(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("order_status") == "delivered")


def monthly_revenue(orders: DataFrame, payments: DataFrame) -> DataFrame:
    j = (_delivered(orders).select("order_id", "order_purchase_timestamp")
         .join(payments.select("order_id", "payment_value"), "order_id"))
    return (j.groupBy(month_label("order_purchase_timestamp").alias("month"))
             .agg(money_sum("payment_value").alias("raw_revenue"))
             .withColumn("revenue_millions", F.col("raw_revenue") / F.lit(MILLION))
             .orderBy("month"))


def monthly_kpis(orders: DataFrame, payments: DataFrame, customers: DataFrame) -> DataFrame:
    """Revenue and two exact distinct counts per month (delivered orders).

    Payments are summed to order grain right after the order_id join (no
    extra shuffle); each order then is one row, so "distinct orders" is a
    plain count and only the customer count stays a distinct aggregate
    (one distinct column: no Expand of the rows).
    """
    per_order = (_delivered(orders).select("order_id", "customer_id", "order_purchase_timestamp")
                 .join(payments.select("order_id", "payment_value"), "order_id")
                 .groupBy("order_id", "customer_id", month_label("order_purchase_timestamp").alias("month"))
                 .agg(F.sum(F.col("payment_value").cast(MONEY)).alias("rev")))
    j = per_order.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
    return (j.groupBy("month")
             .agg(F.sum("rev").cast("double").alias("revenue"),
                  F.count("order_id").alias("orders"),
                  F.count_distinct("customer_unique_id").alias("customers")))


def _pct_change(cur: str, prev: str) -> F.Column:
    c, p = F.col(cur).cast("double"), F.col(prev).cast("double")
    return F.when(p.isNull(), F.lit(0.0)).otherwise(F.try_divide(c - p, p) * F.lit(100.0))


def mom_delta(monthly: DataFrame) -> DataFrame:
    """Month-over-month % change of the newest month against the one before.

    Newest = first in ``month DESC NULLS FIRST`` order, as in the SQL the
    reference runs. 0.0 unless two months exist. ``monthly`` is one row per
    month, so the un-partitioned window is over a bounded input.
    """
    w = Window.orderBy(F.col("month").desc_nulls_first())
    ranked = monthly.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    pick = lambda name, rn: F.max(F.when(F.col("rn") == rn, F.col(name)))
    two = ranked.agg(
        F.max(F.when(F.col("rn") == 1, F.col("month"))).alias("month"),
        F.max(F.when(F.col("rn") == 2, F.col("month"))).alias("prev_month"),
        pick("revenue", 1).alias("rev1"), pick("revenue", 2).alias("rev2"),
        pick("orders", 1).alias("ord1"), pick("orders", 2).alias("ord2"),
        pick("customers", 1).alias("cus1"), pick("customers", 2).alias("cus2"),
        F.count("*").alias("n"),
    )
    ok = F.col("n") == 2
    return two.select(
        "month", "prev_month",
        F.when(ok, _pct_change("rev1", "rev2")).otherwise(0.0).alias("revenue_delta"),
        F.when(ok, _pct_change("ord1", "ord2")).otherwise(0.0).alias("orders_delta"),
        F.when(ok, _pct_change("cus1", "cus2")).otherwise(0.0).alias("customers_delta"),
    )


def category_sales(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Items sold per English category; the join key is trimmed on both sides.

    ``translation`` is a dimension (one row per category). No broadcast hint:
    AQE turns the join into a broadcast only when the measured side is under
    the broadcast threshold, and keeps the shuffle join otherwise. Items are
    counted per product first, so the joins move one row a product.
    """
    sold = items.groupBy("product_id").agg(F.count("order_item_id").alias("n"))
    p = products.select("product_id", F.trim("product_category_name").alias("cat_key"))
    t = translation.select(F.trim("product_category_name").alias("cat_key"),
                           F.col("product_category_name_english").alias("category_raw"))
    return (sold.join(p, "product_id")
            .join(t, "cat_key")
            .groupBy("category_raw")
            .agg(F.sum("n").alias("total_sold")))


def top_categories(sales: DataFrame, k: int = 10) -> DataFrame:
    """Top-k categories (ties broken by name), labelled for display."""
    top = sales.orderBy(F.col("total_sold").desc(), F.col("category_raw").asc()).limit(k)
    return (top.select(category_label("category_raw").alias("category"), "total_sold")
               .orderBy(F.col("total_sold").asc(), F.col("category").desc()))


def status_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_status").agg(F.count("order_id").alias("total"))


def status_share(counts: DataFrame) -> DataFrame:
    """Percent of all orders per status (window over a handful of rows)."""
    tot = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return counts.select("order_status", "total",
                         (F.col("total").cast("double") / tot.cast("double") * F.lit(100.0))
                         .alias("share_pct"))


def summary_context(top: DataFrame) -> DataFrame:
    """Best-selling category of the top-k list (input of the summary text)."""
    return (top.orderBy(F.col("total_sold").desc(), F.col("category").asc()).limit(1)
               .select(F.col("category").alias("top_category"), "total_sold"))
