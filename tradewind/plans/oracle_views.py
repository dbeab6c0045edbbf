"""The business views as plain SQL (DuckDB dialect) for the oracle texts.

Each oracle text is ``with_views(body)``: the same view definitions as
``tradewind.sources.adapter``, written over the driver tables, followed by
the query body. Unreferenced CTEs cost nothing.
"""

from __future__ import annotations

VIEWS_SQL = """
WITH
b_first_ship AS (
  SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey
),
b_orders_base AS (
  SELECT o_orderkey, o_custkey,
         CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN 'delivered'
              WHEN o_orderstatus = 'O' THEN 'shipped'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'canceled'
              WHEN o_orderstatus = 'P' THEN 'processing' END AS order_status,
         o_orderdate AS order_purchase_timestamp,
         o_orderdate AS order_approved_at,
         o_orderdate + INTERVAL '30' DAY AS order_estimated_delivery_date
  FROM orders
),
b_orders AS (
  SELECT b.*,
         CASE WHEN b.order_status IN ('delivered', 'shipped') THEN f.first_ship END
           AS order_delivered_carrier_date,
         CASE WHEN b.order_status = 'delivered' THEN f.first_ship END
           AS order_delivered_customer_date
  FROM b_orders_base b LEFT JOIN b_first_ship f ON f.l_orderkey = b.o_orderkey
),
b_items AS (
  SELECT l_orderkey AS o_orderkey,
         CAST(l_orderkey AS VARCHAR) AS order_id,
         l_linenumber AS order_item_id,
         CAST(l_partkey AS VARCHAR) AS product_id,
         CAST(l_suppkey AS VARCHAR) AS seller_id,
         l_extendedprice AS price,
         l_extendedprice * l_tax AS freight_value,
         l_returnflag = 'R' AS is_returned,
         l_partkey, l_suppkey, l_linenumber
  FROM lineitem
),
b_ptype AS (
  SELECT o_orderkey, o_totalprice,
         CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'boleto'
              WHEN '3-MEDIUM' THEN 'voucher' WHEN '4-NOT SPECIFIED' THEN 'debit_card'
              WHEN '5-LOW' THEN 'credit_card' END AS payment_type
  FROM orders
),
b_payments AS (
  SELECT o_orderkey, order_id, 1 AS payment_sequential, payment_type,
         CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * CAST(0.6 AS DOUBLE)
              ELSE o_totalprice END AS payment_value
  FROM b_ptype
  UNION ALL
  SELECT o_orderkey, order_id, 2 AS payment_sequential, 'voucher' AS payment_type,
         o_totalprice * CAST(0.4 AS DOUBLE) AS payment_value
  FROM b_ptype WHERE o_orderkey % 2 = 0
),
b_reviews AS (
  SELECT o_orderkey,
         CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS INTEGER) AS review_score,
         o_orderdate + INTERVAL '31' DAY AS review_creation_date,
         o_orderdate + INTERVAL '32' DAY AS review_answer_timestamp
  FROM orders WHERE o_orderkey % 10 <> 0
),
b_products AS (
  SELECT p_partkey,
         CAST(p_partkey AS VARCHAR) AS product_id,
         ' ' || replace(p_name, ' ', '_') AS product_category_name,
         p_size * CAST(400.0 AS DOUBLE) AS product_weight_g
  FROM part
),
b_categories AS (
  SELECT DISTINCT replace(p_name, ' ', '_') AS product_category_name,
         replace(p_name, ' ', '_') AS product_category_name_english
  FROM part
),
b_customers AS (
  SELECT c_custkey,
         CAST(c_custkey AS VARCHAR) AS customer_id,
         c_name AS customer_unique_id,
         c_name AS customer_name
  FROM customer
),
b_sellers AS (
  SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS seller_id,
         s_name AS seller_name
  FROM supplier
)
"""


def with_views(body: str, extra_ctes: str = "") -> str:
    """Prefix a query body with the view CTEs (and optional extra CTEs).

    ``extra_ctes`` is a comma-led list ``, name AS (...), ...``.
    """
    return VIEWS_SQL + extra_ctes + "\n" + body


def money_sum(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"


def money_avg(expr: str) -> str:
    return f"(CAST(sum(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE) / NULLIF(count({expr}), 0))"


def int_avg(expr: str) -> str:
    return f"(CAST(sum(CAST({expr} AS BIGINT)) AS DOUBLE) / NULLIF(count({expr}), 0))"
