"""Privacy, outreach, weekly rollup, retrieval and CSV ingest queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradewind.functions.dates import month_label_text
from tradewind.operators import privacy as PV
from tradewind.operators import rules as RU
from tradewind.operators import vector_index as VI
from tradewind.plans import rule_plans as RP
from tradewind.plans.catalog import register
from tradewind.plans.oracle_views import money_sum, with_views
from tradewind.session import scratch_dir
from tradewind.sources import ingest as IG
from tradewind.sources.business import from_testdata
from tradewind.sources.tables import read_table, spread

EMAIL_RX_SQL = r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"

# ---------------------------------------------------------------- privacy


@register("mask_email", with_views(
    f"SELECT doc_id, regexp_replace(text, '{EMAIL_RX_SQL}', '\\1***@\\2', 'g') AS masked_text FROM documents"))
def mask_email(spark, d):
    return PV.masked_documents(spread(read_table(spark, d, "documents")))


@register("mask_name", with_views(
    r"SELECT customer_id, regexp_replace(customer_name, '(\S)\S*', '\1***', 'g') AS masked_name FROM b_customers"))
def mask_name(spark, d):
    return PV.masked_names(from_testdata(spark, d).customers)


#: The key of the test data's pseudonyms, so that both engines make the same ones; real runs pass their own.
TEST_KEY = b"tradewind test key"
_PADS = {x: "".join(f"{b ^ x:02X}" for b in TEST_KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)}


@register("anonymize_customers", with_views(
    f"SELECT sha256(unhex('{_PADS[0x5C]}') || unhex(sha256(unhex('{_PADS[0x36]}') || encode(customer_id)))) AS anon_id, "
    r"regexp_replace(customer_name, '(\S)\S*', '\1***', 'g') AS masked_name FROM b_customers"))
def anonymize_customers(spark, d):
    return PV.anonymized_customers(from_testdata(spark, d).customers, TEST_KEY)


def _outreach_case():
    parts = []
    for code, tpl in PV.OUTREACH_TEMPLATES.items():
        pre, _, post = tpl.replace("{voucher}", PV.VOUCHER_CODE).partition("{name}")
        q = lambda s: "'" + s.replace("'", "''") + "'"
        parts.append(f"WHEN h.rule = '{code}' THEN {q(pre)} || m.masked_name || {q(post)}")
    return "CASE " + " ".join(parts) + " END"


@register("outreach_queue", with_views(f"""
SELECT h.customer_id, h.rule, 'email' AS channel, {_outreach_case()} AS message
FROM ({RP.CHURN_RULES_BODY}) h
JOIN (SELECT customer_id, regexp_replace(customer_name, '(\\S)\\S*', '\\1***', 'g') AS masked_name
      FROM b_customers) m ON h.customer_id = m.customer_id
""", RP.CHURN_RULE_CTES))
def outreach_queue(spark, d):
    b = from_testdata(spark, d)
    return PV.outreach_queue(RU.churn_rules(RP.churn_rule_table(b)), b.customers)


@register("seller_weekly", with_views(f"""
SELECT seller_id, week, orders, revenue, cancel_rate,
       orders - lag(orders) OVER (PARTITION BY seller_id ORDER BY week) AS orders_change,
       (revenue - lag(revenue) OVER (PARTITION BY seller_id ORDER BY week))
         / NULLIF(lag(revenue) OVER (PARTITION BY seller_id ORDER BY week), 0) * CAST(100.0 AS DOUBLE)
         AS revenue_change_pct
FROM (
  SELECT i.seller_id, CAST(date_trunc('week', o.order_purchase_timestamp) AS DATE) AS week,
         count(DISTINCT i.order_id) AS orders, {money_sum('i.price')} AS revenue,
         CAST(sum(CASE WHEN o.order_status = 'canceled' THEN 1 ELSE 0 END) AS DOUBLE) / NULLIF(count(*), 0)
           AS cancel_rate
  FROM b_items i JOIN b_orders_base o ON i.order_id = o.order_id GROUP BY 1, 2) w
"""))
def seller_weekly(spark, d):
    return PV.seller_weekly(from_testdata(spark, d))


_TOPK_SQL = with_views("""
SELECT query_label, rank, vec_id, round(score, 6) AS score FROM (
  SELECT query_label, vec_id, score,
         row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id ASC) AS rank
  FROM (
    SELECT c.query_label, e.vec_id,
           list_sum(list_transform(list_zip(e.embedding, c.centroid), lambda x: CAST(x[1] AS DOUBLE) * x[2]))
           / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
              * sqrt(list_sum(list_transform(c.centroid, lambda x: x * x)))) AS score
    FROM embeddings e, cent c) s) r
WHERE rank <= 10
""", """, ex AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS v
           FROM embeddings),
cent AS (SELECT label AS query_label, list(m ORDER BY i) AS centroid
         FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM ex GROUP BY 1, 2) g GROUP BY 1)
""")


@register("retrieve_topk", _TOPK_SQL)
def retrieve_topk(spark, d):
    v = read_table(spark, d, "embeddings")
    return PV.retrieve_topk(v, PV.label_centroids(v), k=10)


def _indexed(spark, d, probes):
    v = read_table(spark, d, "embeddings")
    index = VI.VectorIndex.build(v)
    found, cells = index.search(PV.label_centroids(v), 10, probes, id_col="query_label", vector_col="centroid")
    return index, found.select(F.col("query").alias("query_label"), "rank", "vec_id", F.round("score", 6).alias("score")), cells


@register("retrieve_index", _TOPK_SQL)
def retrieve_index(spark, d):
    """The same search through the stored cells, exact: cells that no bound excludes are read."""
    return _indexed(spark, d, None)[1]


#: Cells that the approximate search looks into: a third.
PROBES = VI.CELLS // 3


@register("retrieve_recall", "SELECT count(DISTINCT label) AS queries, true AS enough FROM embeddings")
def retrieve_recall(spark, d):
    """Queries of the approximate search, and whether it finds 0.9 of what the plain scan finds."""
    v = read_table(spark, d, "embeddings")
    _, found, _ = _indexed(spark, d, PROBES)
    exact = PV.retrieve_topk(v, PV.label_centroids(v), k=10).select("query_label", "vec_id")
    hits = exact.join(found.select("query_label", "vec_id", F.lit(1).alias("hit")), ["query_label", "vec_id"], "left")
    return hits.agg(F.countDistinct("query_label").alias("queries"), (F.count("hit") >= 0.9 * F.count("vec_id")).alias("enough"))


# ---------------------------------------------------------------- ingest


# The business tables that the adapter makes, as the ETL's input files; the numeric and
# time columns of each, which the load checks by their exact sums.
_EXTRACTS = {
    "orders": ("b_orders", ["order_purchase_timestamp", "order_delivered_customer_date"]),
    "order_items": ("b_items", ["order_item_id", "price", "freight_value"]),
    "order_payments": ("b_payments", ["payment_sequential", "payment_value"]),
    "order_reviews": ("b_reviews", ["review_score"]),
    "products": ("b_products", ["product_weight_g"]),
    "category_translation": ("b_categories", []),
    "customers": ("b_customers", []),
    "sellers": ("b_sellers", []),
}


def _frames(spark, d):
    b = from_testdata(spark, d)
    return {"orders": b.orders, "order_items": b.items, "order_payments": b.payments,
            "order_reviews": b.reviews, "products": b.products, "category_translation": b.translation,
            "customers": b.customers, "sellers": b.sellers}


def _extract_dir(spark, d, tables):
    """Write business tables, all their columns, as CSV extracts."""
    frames = _frames(spark, d)
    out = scratch_dir(spark, f"extracts/{uuid.uuid4().hex}")
    IG.write_extracts(spark, {t: frames[t] for t in tables}, out)
    return out


_ORDER_COLS = ("order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at, "
               "order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date")
#: The column of each table whose values the checks count.
_KEYS = {"orders": "customer_id", "order_items": "product_id", "order_payments": "payment_type", "order_reviews": "order_id",
         "products": "product_id", "category_translation": "product_category_name", "customers": "customer_id",
         "sellers": "seller_id"}
_SUMMARY = []
for _t, (_v, _sums) in _EXTRACTS.items():
    _key = _KEYS[_t]
    _nums = [f"CAST(sum({'CAST(' + c + ' AS DECIMAL(18,4))' if not c.endswith(('timestamp', 'date')) else 'CAST(epoch(' + c + ') AS BIGINT)'}) AS DOUBLE)"
             for c in _sums]
    _SUMMARY.append(f"SELECT '{_t}' AS \"table\", count(*) AS rows, count({_key}) AS keys, count(DISTINCT {_key}) AS distinct_keys, "
                    f"{' + '.join(f'coalesce({n}, 0)' for n in _nums) or '0.0'} AS total FROM (SELECT DISTINCT * FROM {_v})")


@register("ingest_tables", with_views(" UNION ALL ".join(_SUMMARY)))
def ingest_tables(spark, d):
    """Every table of the catalogue through the whole load; one row of checks a table."""
    out = None
    base = scratch_dir(spark, f"ingested/{uuid.uuid4().hex}")
    IG.load(spark, _extract_dir(spark, d, _EXTRACTS), base)
    for t, (_, sums) in _EXTRACTS.items():
        df = spark.read.parquet(f"{base}/{t}")
        key = _KEYS[t]
        total = F.lit(0.0)
        for c in sums:
            x = (F.unix_seconds(F.col(c).cast("timestamp")) if c.endswith(("timestamp", "date")) else F.col(c).cast("decimal(18,4)"))
            total = total + F.coalesce(F.sum(x).cast("double"), F.lit(0.0))
        row = df.agg(F.count("*").alias("rows"), F.count(key).alias("keys"), F.countDistinct(key).alias("distinct_keys"),
                     total.alias("total")).select(F.lit(t).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("coerce_timestamps", with_views(f"SELECT {_ORDER_COLS} FROM b_orders"))
def coerce_timestamps(spark, d):
    tables, _ = IG.ingest(spark, _extract_dir(spark, d, ["orders"]), dedup=False)
    return tables["orders"].select(*_ORDER_COLS.split(", "))


@register("coerce_review_dates", with_views("SELECT order_id, review_score, review_creation_date, review_answer_timestamp FROM b_reviews"))
def coerce_review_dates(spark, d):
    """S3: the two review columns, of the file with free text."""
    tables, _ = IG.ingest(spark, _extract_dir(spark, d, ["order_reviews"]), dedup=False)
    return tables["order_reviews"].select("order_id", "review_score", "review_creation_date", "review_answer_timestamp")


@register("month_text", with_views(
    "SELECT substring(strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S'), 1, 7) AS month, count(*) AS orders FROM b_orders_base GROUP BY 1"))
def month_text(spark, d):
    """the month as the first seven characters of the time's text."""
    o = from_testdata(spark, d).orders_nodates
    return o.groupBy(month_label_text("order_purchase_timestamp").alias("month")).agg(F.count(F.lit(1)).alias("orders"))


@register("dedup_rows", with_views(f"SELECT DISTINCT {_ORDER_COLS} FROM b_orders"))
def dedup_rows(spark, d):
    """The same extract loaded twice collapses to one copy of each row."""
    out = _extract_dir(spark, d, ["orders"])
    text = IG.read_csv_text(spark, f"{out}/olist_orders_dataset.csv", "orders")
    twice = IG.coerce(text.unionByName(text), IG.SCHEMAS["orders"])
    return twice.dropDuplicates().select(*_ORDER_COLS.split(", "))


@register("table_sink_roundtrip", with_views(
    "SELECT product_id, product_category_name, product_weight_g FROM b_products"))
def table_sink_roundtrip(spark, d):
    """Full-replace sink written twice (idempotent), read back."""
    from tradewind.sources.sinks import write_table
    p = from_testdata(spark, d).products.select("product_id", "product_category_name", "product_weight_g")
    path = scratch_dir(spark, f"sink/{uuid.uuid4().hex}/products")
    write_table(p, path, "overwrite")
    write_table(p, path, "overwrite")
    return spark.read.parquet(path)


_REPORT = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{f}' AS file, '{'loaded' if t in _EXTRACTS else 'missing'}' AS status, "
    + (f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {_EXTRACTS[t][0]}))" if t in _EXTRACTS else "CAST(NULL AS BIGINT)") + " AS rows"
    for f, t in IG.CATALOGUE.items())


@register("ingest_report", with_views(_REPORT))
def ingest_report(spark, d):
    """Status and rows of every entry of the catalogue; the test data has no geolocation file."""
    return IG.load(spark, _extract_dir(spark, d, _EXTRACTS), scratch_dir(spark, f"ingested/{uuid.uuid4().hex}"))
