"""Dashboard queries (KPIs, monthly trend, charts)."""

from __future__ import annotations

from tradewind.operators import dashboards as dash
from tradewind.plans.catalog import register
from tradewind.plans.oracle_views import money_sum, with_views
from tradewind.sources.business import from_testdata


@register("kpi_totals", with_views(f"""
SELECT 'total_revenue' AS metric, {money_sum('payment_value')} AS value FROM b_payments
UNION ALL
SELECT 'total_revenue_vnd', {money_sum('payment_value')} * CAST(4500.0 AS DOUBLE) FROM b_payments
UNION ALL
SELECT 'total_orders', CAST(count(order_id) AS DOUBLE) FROM b_orders_base
UNION ALL
SELECT 'total_customers', CAST(count(DISTINCT customer_unique_id) AS DOUBLE) FROM b_customers
"""))
def kpi_totals(spark, d):
    b = from_testdata(spark, d)
    return dash.kpi_totals(b.payments, b.orders_nodates, b.customers)


@register("monthly_revenue", with_views(f"""
SELECT strftime(o.order_purchase_timestamp, '%Y-%m') AS month,
       {money_sum('p.payment_value')} AS raw_revenue,
       {money_sum('p.payment_value')} / CAST(1000000.0 AS DOUBLE) AS revenue_millions
FROM b_orders_base o JOIN b_payments p ON o.order_id = p.order_id
WHERE o.order_status = 'delivered'
GROUP BY 1 ORDER BY 1
"""))
def monthly_revenue(spark, d):
    b = from_testdata(spark, d)
    return dash.monthly_revenue(b.orders_nodates, b.payments)


_MONTHLY_KPIS_SQL = f"""
SELECT strftime(o.order_purchase_timestamp, '%Y-%m') AS month,
       {money_sum('p.payment_value')} AS revenue,
       count(DISTINCT o.order_id) AS orders,
       count(DISTINCT c.customer_unique_id) AS customers
FROM b_orders_base o JOIN b_payments p ON o.order_id = p.order_id
JOIN b_customers c ON o.customer_id = c.customer_id
WHERE o.order_status = 'delivered'
GROUP BY 1
"""


@register("monthly_kpis", with_views(_MONTHLY_KPIS_SQL))
def monthly_kpis(spark, d):
    b = from_testdata(spark, d)
    return dash.monthly_kpis(b.orders_nodates, b.payments, b.customers)


def _pct(cur, prev):
    return (f"CASE WHEN {prev} IS NULL THEN 0.0 ELSE "
            f"(CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) / NULLIF(CAST({prev} AS DOUBLE), 0)"
            f" * CAST(100.0 AS DOUBLE) END")


@register("mom_delta", with_views(f"""
SELECT max(CASE WHEN rn = 1 THEN month END) AS month,
       max(CASE WHEN rn = 2 THEN month END) AS prev_month,
       CASE WHEN count(*) = 2 THEN {_pct('max(CASE WHEN rn = 1 THEN revenue END)', 'max(CASE WHEN rn = 2 THEN revenue END)')} ELSE 0.0 END AS revenue_delta,
       CASE WHEN count(*) = 2 THEN {_pct('max(CASE WHEN rn = 1 THEN orders END)', 'max(CASE WHEN rn = 2 THEN orders END)')} ELSE 0.0 END AS orders_delta,
       CASE WHEN count(*) = 2 THEN {_pct('max(CASE WHEN rn = 1 THEN customers END)', 'max(CASE WHEN rn = 2 THEN customers END)')} ELSE 0.0 END AS customers_delta
FROM (SELECT *, row_number() OVER (ORDER BY month DESC NULLS FIRST) AS rn FROM monthly) t
WHERE rn <= 2
""", extra_ctes=f", monthly AS ({_MONTHLY_KPIS_SQL})"))
def mom_delta(spark, d):
    return dash.mom_delta(monthly_kpis(spark, d))


# Items are counted per product first; the categories' names are matched by product.
_CATEGORY_SALES_SQL = """
SELECT product_category_name_english AS category_raw, CAST(sum(sold) AS BIGINT) AS total_sold
FROM (SELECT product_id, count(order_item_id) AS sold FROM b_items GROUP BY product_id) per_product
JOIN (SELECT product_id, trim(product_category_name) AS named FROM b_products) USING (product_id)
JOIN (SELECT trim(product_category_name) AS named, product_category_name_english FROM b_categories) USING (named)
GROUP BY product_category_name_english
"""

_TITLE_SQL = ("array_to_string(list_transform(string_split(replace(category_raw, '_', ' '), ' '), "
              "lambda x: upper(x[1]) || lower(x[2:])), ' ')")

_TOP_SQL = f"""
SELECT {_TITLE_SQL} AS category, total_sold
FROM (SELECT * FROM sales ORDER BY total_sold DESC, category_raw ASC LIMIT 10) t
"""


def _category_sales(spark, d):
    b = from_testdata(spark, d)
    return dash.category_sales(b.items, b.products, b.translation)


@register("top_categories", with_views(_TOP_SQL, extra_ctes=f", sales AS ({_CATEGORY_SALES_SQL})"))
def top_categories(spark, d):
    return dash.top_categories(_category_sales(spark, d))


@register("status_counts", with_views("""
SELECT order_status, count(order_id) AS total FROM b_orders_base GROUP BY order_status
"""))
def status_counts(spark, d):
    return dash.status_counts(from_testdata(spark, d).orders_nodates)


@register("status_share", with_views("""
SELECT order_status, total,
       CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS DOUBLE) * CAST(100.0 AS DOUBLE) AS share_pct
FROM (SELECT order_status, count(order_id) AS total FROM b_orders_base GROUP BY order_status) s
"""))
def status_share(spark, d):
    return dash.status_share(status_counts(spark, d))


@register("summary_context", with_views(f"""
SELECT category AS top_category, total_sold FROM ({_TOP_SQL}) t
ORDER BY total_sold DESC, category ASC LIMIT 1
""", extra_ctes=f", sales AS ({_CATEGORY_SALES_SQL})"))
def summary_context(spark, d):
    return dash.summary_context(top_categories(spark, d))
