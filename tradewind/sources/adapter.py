"""Business views over the driver tables.

The reference works on a marketplace schema (orders, order_items,
order_payments, order_reviews, products, category_translation, customers,
sellers). The test data is TPC-H shaped, so each view below is a lazy
projection of one driver table (plus one aggregate for delivery dates).
Ids are strings, as in the marketplace schema: the decimal text of the
source key (cheap to build and to hash-partition; a longer hashed id would
cost a digest per row and wider shuffle keys for no semantic gain).

Every function returns a lazy DataFrame; nothing is materialised here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sources.tables import read_table

# Fixed values of the adapter (our choice, documented in README):
# order status from TPC-H status and priority, payment type from priority.
ESTIMATE_DAYS = 30
PAYMENT_TYPE_BY_PRIORITY = {
    "1-URGENT": "credit_card",
    "2-HIGH": "boleto",
    "3-MEDIUM": "voucher",
    "4-NOT SPECIFIED": "debit_card",
    "5-LOW": "credit_card",
}
SECOND_PAYMENT_TYPE = "voucher"
FIRST_PAYMENT_SHARE = 0.6
SECOND_PAYMENT_SHARE = 0.4
GRAMS_PER_SIZE = 400.0


def make_id(tag: str, key: Column | str) -> Column:
    """String id of an entity (``tag`` names the entity kind for readers)."""
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("string")


def order_id(key="o_orderkey") -> Column:
    return make_id("order", key)


def customer_id(key="o_custkey") -> Column:
    return make_id("customer", key)


def seller_id(key="l_suppkey") -> Column:
    return make_id("seller", key)


def product_id(key="l_partkey") -> Column:
    return make_id("product", key)


def _status() -> Column:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (F.when(s == "F", "delivered")
             .when(s == "O", "shipped")
             .when((s == "P") & (p == "1-URGENT"), "canceled")
             .when(s == "P", "processing"))


#: Deals source rows by the order id that is made of the named key, before wider columns are made of them.
Deal = Callable[[DataFrame, str], DataFrame]


def as_read(rows: DataFrame, key: str) -> DataFrame:
    return rows


def delivery_dates(spark: SparkSession, d: str) -> DataFrame:
    """First ship date per order (partial + final hash aggregate)."""
    li = read_table(spark, d, "lineitem")
    return (li.groupBy("l_orderkey")
              .agg(F.min("l_shipdate").alias("first_ship"))
              .withColumnRenamed("l_orderkey", "o_orderkey"))


def orders(spark: SparkSession, d: str, with_delivery: bool = True, deal: Deal = as_read) -> DataFrame:
    o = deal(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), "o_orderkey")
    base = o.select(
        "o_orderkey", "o_custkey",
        order_id().alias("order_id"),
        customer_id().alias("customer_id"),
        _status().alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.col("o_orderdate").alias("order_approved_at"),
        (F.col("o_orderdate") + F.expr(f"INTERVAL {ESTIMATE_DAYS} DAYS"))
        .alias("order_estimated_delivery_date"),
    )
    if not with_delivery:
        return base
    # Left join on the order; both sides are dealt alike.
    dates = deal(delivery_dates(spark, d), "o_orderkey")
    j = base.join(dates.select(order_id().alias("order_id"), "first_ship"), "order_id", "left")
    return j.select(
        *[c for c in base.columns],
        F.when(F.col("order_status").isin("delivered", "shipped"), F.col("first_ship"))
         .alias("order_delivered_carrier_date"),
        F.when(F.col("order_status") == "delivered", F.col("first_ship"))
         .alias("order_delivered_customer_date"),
    )


def order_items(spark: SparkSession, d: str, deal: Deal = as_read) -> DataFrame:
    li = deal(read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax",
                                                      (F.col("l_returnflag") == "R").alias("is_returned")), "l_orderkey")
    return li.select(
        F.col("l_orderkey").alias("o_orderkey"),
        order_id("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        product_id("l_partkey").alias("product_id"),
        seller_id("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        "is_returned", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
    )


def _payment_type() -> Column:
    e = None
    for prio, typ in PAYMENT_TYPE_BY_PRIORITY.items():
        e = (F.when(F.col("o_orderpriority") == prio, typ) if e is None
             else e.when(F.col("o_orderpriority") == prio, typ))
    return e


def order_payments(spark: SparkSession, d: str, deal: Deal = as_read) -> DataFrame:
    """Odd order keys pay once; even keys pay twice (60 % + 40 %)."""
    o = deal(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey")
    even = (F.col("o_orderkey") % 2) == 0
    one = F.struct(F.lit(1).alias("payment_sequential"), _payment_type().alias("payment_type"),
                   F.col("o_totalprice").alias("payment_value"))
    first = F.struct(F.lit(1).alias("payment_sequential"), _payment_type().alias("payment_type"),
                     (F.col("o_totalprice") * F.lit(FIRST_PAYMENT_SHARE)).alias("payment_value"))
    second = F.struct(F.lit(2).alias("payment_sequential"),
                      F.lit(SECOND_PAYMENT_TYPE).alias("payment_type"),
                      (F.col("o_totalprice") * F.lit(SECOND_PAYMENT_SHARE)).alias("payment_value"))
    rows = F.when(even, F.array(first, second)).otherwise(F.array(one))
    return (o.select("o_orderkey", order_id().alias("order_id"), F.explode(rows).alias("p"))
             .select("o_orderkey", "order_id", "p.payment_sequential", "p.payment_type",
                     "p.payment_value"))


def order_reviews(spark: SparkSession, d: str, deal: Deal = as_read) -> DataFrame:
    """One review per order except every tenth order key (no review)."""
    o = deal(read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    return (o.where((F.col("o_orderkey") % 10) != 0)
             .select(
                 "o_orderkey",
                 order_id().alias("order_id"),
                 (F.lit(1) + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 5)
                 .cast("int").alias("review_score"),
                 (F.col("o_orderdate") + F.expr("INTERVAL 31 DAYS")).alias("review_creation_date"),
                 (F.col("o_orderdate") + F.expr("INTERVAL 32 DAYS")).alias("review_answer_timestamp"),
             ))


def products(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(
        F.col("p_partkey"),
        product_id("p_partkey").alias("product_id"),
        # leading blank exercises the TRIM join of the category chart
        F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "_")).alias("product_category_name"),
        (F.col("p_size") * F.lit(GRAMS_PER_SIZE)).alias("product_weight_g"),
    )


def category_translation(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    name = F.regexp_replace("p_name", " ", "_")
    return (p.select(name.alias("product_category_name"))
             .distinct()
             .select("product_category_name",
                     F.col("product_category_name").alias("product_category_name_english")))


def customers(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        "c_custkey",
        customer_id("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_unique_id"),
        F.col("c_name").alias("customer_name"),
    )


def sellers(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    return s.select("s_suppkey", seller_id("s_suppkey").alias("seller_id"),
                    F.col("s_name").alias("seller_name"))


VIEWS = {
    "orders": orders,
    "order_items": order_items,
    "order_payments": order_payments,
    "order_reviews": order_reviews,
    "products": products,
    "category_translation": category_translation,
    "customers": customers,
    "sellers": sellers,
}


def register_views(spark: SparkSession, d: str, prefix: str = "") -> None:
    """Register the business views as temp views for spark.sql users."""
    for name, fn in VIEWS.items():
        fn(spark, d).createOrReplaceTempView(prefix + name)
