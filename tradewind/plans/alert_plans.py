"""Alert feed, focus lists, prefix lookups, action events and audit trail."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.text import CUSTOMER_WORD, ORDER_WORD, SELLER_WORD, entity_pattern
from tradewind.operators import actions as AC
from tradewind.operators import alerts as AL
from tradewind.operators import features as FE
from tradewind.operators import rules as RU
from tradewind.plans import rule_plans as RP
from tradewind.plans.catalog import register
from tradewind.plans.feature_plans import RISK_BASE_SQL, churn_agg_sql, seller_agg_sql
from tradewind.plans.oracle_views import with_views
from tradewind.session import scratch_dir
from tradewind.sources.alert_source import MSG_ACTION, raw_alerts, raw_alerts_sql
from tradewind.sources.business import Biz, from_testdata
from tradewind.sources.feed_log import OLDEST, FeedLog

FEED_SCHEMA = "seq bigint, raw string"

# ---------------------------------------------------------------- SQL pieces

VALID_SQL = ("CASE WHEN json_valid(raw) THEN json_type(raw) = 'OBJECT' AND "
             "coalesce(json_type(raw, '$.message'), 'VARCHAR') IN ('VARCHAR', 'ARRAY', 'OBJECT') ELSE false END")


def parsed_sql(src: str) -> str:
    def g(path):
        return f"CASE WHEN json_valid(raw) THEN json_extract_string(raw, '{path}') END"
    return f"""
  SELECT seq, event_time, {g('$.order_id')} AS order_id,
         TRY_CAST({g('$.risk_score')} AS DOUBLE) AS risk_score,
         coalesce({g('$.type')}, 'warning') AS type,
         coalesce({g('$.message')}, '') AS message,
         coalesce({g('$.timestamp')}, '') AS "timestamp",
         CASE WHEN json_valid(raw) THEN CASE json_type(raw, '$.message') WHEN 'ARRAY' THEN json_extract_string(raw, '$.message[*]')
              WHEN 'OBJECT' THEN json_keys(raw, '$.message') END END AS words
  FROM {src} WHERE {VALID_SQL}"""


def _has(word: str) -> str:
    return f"CASE WHEN words IS NULL THEN contains(message, '{word}') ELSE list_contains(words, '{word}') END"


ROUTE_SQL = (f"CASE WHEN {_has('[CHURN]')} OR {_has(CUSTOMER_WORD)} THEN 'churn' "
             f"WHEN {_has(SELLER_WORD)} THEN 'seller' ELSE 'delivery' END")


def _rx(word):
    return f"NULLIF(regexp_extract(message, '{entity_pattern(word)}', 1), '')"


ENTITY_SQL = (f"CASE WHEN words IS NOT NULL THEN NULL WHEN route = 'churn' AND contains(message, '{CUSTOMER_WORD}') THEN {_rx(CUSTOMER_WORD)} "
              f"WHEN route = 'seller' AND contains(message, '{SELLER_WORD}') THEN {_rx(SELLER_WORD)} "
              f"WHEN route = 'delivery' AND contains(message, '{ORDER_WORD}') THEN {_rx(ORDER_WORD)} END")

ALERT_CTES = f""", raw AS ({raw_alerts_sql()}),
parsed AS ({parsed_sql('raw')}),
routed AS (SELECT *, {ROUTE_SQL} AS route FROM parsed),
newest AS (SELECT * FROM raw ORDER BY seq DESC LIMIT {AL.FEED_LIMIT}),
pnew AS ({parsed_sql('newest')})
"""

PARSED_COLS = 'seq, event_time, order_id, risk_score, type, message, "timestamp"'

# ---------------------------------------------------------------- feed


def _parsed(spark, d):
    return AL.parse_alerts(raw_alerts(spark, d))


def _routed(spark, d):
    return AL.with_route(_parsed(spark, d))


@register("alert_parse", with_views(f"SELECT {PARSED_COLS} FROM parsed", ALERT_CTES))
def alert_parse(spark, d):
    return _parsed(spark, d).select(AL.ALERT_COLUMNS)


@register("alert_route", with_views("SELECT seq, route FROM routed", ALERT_CTES))
def alert_route(spark, d):
    return _routed(spark, d).select("seq", "route")


@register("alert_entity", with_views(f"SELECT seq, route, {ENTITY_SQL} AS entity_id FROM routed",
                                     ALERT_CTES))
def alert_entity(spark, d):
    return AL.with_entity(_routed(spark, d)).select("seq", "route", "entity_id")


@register("alert_counts", with_views("SELECT route, count(*) AS n FROM routed GROUP BY route", ALERT_CTES))
def alert_counts(spark, d):
    return AL.route_counts(_routed(spark, d))


@register("alert_latest_500", with_views(f"SELECT {PARSED_COLS} FROM pnew", ALERT_CTES))
def alert_latest_500(spark, d):
    return AL.parse_alerts(AL.newest_raw(raw_alerts(spark, d))).select(AL.ALERT_COLUMNS)


@register("alert_top10_per_route", with_views(f"""
SELECT seq, route, message, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY route ORDER BY seq DESC) AS rank FROM routed) t
WHERE rank <= {AL.PER_ROUTE}
""", ALERT_CTES))
def alert_top10_per_route(spark, d):
    return AL.top_per_route(_routed(spark, d)).select("seq", "route", "message", "rank")


@register("alert_append_trim", with_views(
    f"SELECT seq, raw FROM raw ORDER BY seq DESC LIMIT {AL.FEED_LIMIT}", ALERT_CTES))
def alert_append_trim(spark, d):
    """The older half is pushed as one segment, the newer half as the next, the
    log is trimmed, and the newest 500 rows are read from the segments that hold them."""
    raw = raw_alerts(spark, d)
    cut = raw.select(F.percentile_approx("seq", 0.5)).first()[0]
    later = F.coalesce(F.col("seq") > cut, F.lit(False))  # a row without a number is older than all
    log = FeedLog(spark, scratch_dir(spark, f"alert_log/{uuid.uuid4().hex}"), FEED_SCHEMA)
    log.push(raw.where(~later), 1)
    log.push(raw.where(later), 2)
    log.trim(AL.FEED_LIMIT)
    return log.newest(AL.FEED_LIMIT)


# ---------------------------------------------------------------- focus lists


def focus_orders(b: Biz, spark, d) -> DataFrame:
    a = AL.alert_order_ids(AL.newest_raw(raw_alerts(spark, d)))
    need = AL.needed(a)
    wh = RP.newest_orders(b, need + 10, RP.OPEN_STATUSES, with_pos=True) if need else None
    return AL.focus_list(a, _positions(wh, "order_id", 12, a), AL.FALLBACK_ORDER_ID)


def focus_customers(b: Biz, spark, d) -> DataFrame:
    pnew = AL.parse_alerts(AL.newest_raw(raw_alerts(spark, d)))
    a = AL.alert_customer_ids(pnew)
    need = AL.needed(a)
    wh = RP.newest_orders(b, need + 20, with_pos=True) if need else None
    return AL.focus_list(a, _positions(wh, "customer_id", 12, a), AL.FALLBACK_CUSTOMER_ID)


def focus_sellers(b: Biz, spark, d) -> DataFrame:
    pnew = AL.parse_alerts(AL.newest_raw(raw_alerts(spark, d)))
    a = AL.alert_seller_ids(pnew)
    need = AL.needed(a)
    wh = RP.newest_item_sellers(b, need + 20, with_pos=True) if need else None
    return AL.focus_list(a, _positions(wh, "seller_id", 8, a), AL.FALLBACK_SELLER_ID)


def _positions(wh, col, n, like):
    if wh is None:
        return like.limit(0)
    return wh.select(F.substring(col, 1, n).alias("id"), "pos")


def _focus_sql(alert_sel: str, wh_sql: str, extra: int, fallback: str) -> str:
    """Shared SQL: alert ids (pri 0), warehouse ids (pri 1), distinct, first 5."""
    return f""", fa AS ({alert_sel}),
fna AS (SELECT count(DISTINCT id) AS n FROM fa WHERE id IS NOT NULL),
fw AS (SELECT id, pos FROM ({wh_sql}) w
       WHERE (SELECT n FROM fna) < {AL.FOCUS_SIZE} AND pos <= {AL.FOCUS_SIZE} - (SELECT n FROM fna) + {extra}),
fc0 AS (SELECT id, 0 AS pri, pos FROM fa UNION ALL SELECT id, 1, pos FROM fw),
fbest AS (SELECT id, min(pri * 1000000000000 + pos) AS k FROM fc0 WHERE id IS NOT NULL GROUP BY id),
ftop AS (SELECT id FROM fbest ORDER BY k LIMIT {AL.FOCUS_SIZE}),
flist0 AS (SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, id AS focus_id
           FROM fbest WHERE id IN (SELECT id FROM ftop)),
flist AS (SELECT * FROM flist0 UNION ALL SELECT 1, '{fallback}' WHERE NOT EXISTS (SELECT 1 FROM flist0))
"""


FOCUS_ORDERS_CTES = ALERT_CTES + _focus_sql(
    """SELECT substr(order_id, 1, 12) AS id, -seq AS pos FROM (
         SELECT seq, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN json_extract_string(raw, '$.order_id') END AS order_id
         FROM newest) o WHERE order_id IS NOT NULL""",
    """SELECT substr(order_id, 1, 12) AS id,
              row_number() OVER (ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id, order_id) AS pos
       FROM b_orders_base WHERE order_status IN ('processing', 'shipped')""", 10, AL.FALLBACK_ORDER_ID)

FOCUS_CUSTOMERS_CTES = ALERT_CTES + _focus_sql(
    f"""SELECT substr({_rx(CUSTOMER_WORD)}, 1, 12) AS id, -seq AS pos FROM pnew
        WHERE words IS NULL AND (contains(message, '[CHURN]') OR contains(message, '{CUSTOMER_WORD}'))""",
    """SELECT substr(customer_id, 1, 12) AS id,
              row_number() OVER (ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id, customer_id) AS pos
       FROM b_orders_base""", 20, AL.FALLBACK_CUSTOMER_ID)

FOCUS_SELLERS_CTES = ALERT_CTES + _focus_sql(
    f"""SELECT substr({_rx(SELLER_WORD)}, 1, 8) AS id, -seq AS pos FROM pnew
        WHERE words IS NULL AND contains(message, '{SELLER_WORD}')""",
    """SELECT substr(i.seller_id, 1, 8) AS id,
              row_number() OVER (ORDER BY o.order_purchase_timestamp DESC NULLS FIRST, i.order_id,
                                 i.order_item_id, i.product_id, i.seller_id) AS pos
       FROM b_items i JOIN b_orders_base o ON i.order_id = o.order_id""", 20, AL.FALLBACK_SELLER_ID)


@register("focus_list_orders", with_views("SELECT * FROM flist", FOCUS_ORDERS_CTES))
def focus_list_orders(spark, d):
    return focus_orders(from_testdata(spark, d), spark, d)


@register("focus_list_customers", with_views("SELECT * FROM flist", FOCUS_CUSTOMERS_CTES))
def focus_list_customers(spark, d):
    return focus_customers(from_testdata(spark, d), spark, d)


@register("focus_list_sellers", with_views("SELECT * FROM flist", FOCUS_SELLERS_CTES))
def focus_list_sellers(spark, d):
    return focus_sellers(from_testdata(spark, d), spark, d)


# ---------------------------------------------------------------- prefix lookups


def known_payment_types(b: Biz) -> DataFrame:
    """The classes that the encoder is trained on: payment types of delivered orders with an
    item of a known product. Two semi joins on the bucketed order id, no fan-out rows."""
    sold = b.items.join(b.products.select("product_id"), "product_id", "left_semi").select("order_id")
    delivered = b.orders_nodates.where(F.col("order_status") == FE.DELIVERED).select("order_id")
    paid = b.payments.where(F.col("payment_type").isNotNull()).select("order_id", "payment_type")
    return paid.join(delivered, "order_id", "left_semi").join(sold, "order_id", "left_semi").select("payment_type").distinct()


def prefix_lookup_order(b: Biz, ids: DataFrame) -> DataFrame:
    """Form values for each focus order id: first matching row in a stated
    order; null values and missing rows take the form's defaults."""
    ids = F.broadcast(ids)  # at most FOCUS_SIZE rows
    o = (b.orders_nodates.select("order_id", "order_purchase_timestamp")
         .join(ids, F.substring("order_id", 1, 12) == ids.focus_id))
    rows = (o.join(b.items.select("order_id", "order_item_id", "product_id", "seller_id"), "order_id")
             .join(b.payments.select("order_id", "payment_sequential", "payment_value", "payment_type"),
                   "order_id")
             .join(b.products.select("product_id", "product_weight_g"), "product_id"))
    from pyspark.sql import Window
    w = Window.partitionBy("focus_id").orderBy("order_id", "order_item_id", "product_id", "seller_id",
                                              "payment_sequential")
    first = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    classes = known_payment_types(b)
    first_class = classes.select(F.min("payment_type")).scalar()
    first = first.join(classes.withColumn("known", F.lit(True)), "payment_type", "left")
    j = ids.join(first.drop("position"), "focus_id", "left")
    matched = F.col("rn").isNotNull()
    kg = F.coalesce(F.col("product_weight_g") / F.lit(1000.0), F.lit(1.5))
    return j.select(
        "position", "focus_id", matched.alias("matched"),
        F.when(matched, kg).otherwise(1.5).alias("weight_kg"),
        F.when(matched, F.coalesce("payment_value", F.lit(150.0))).otherwise(150.0).alias("order_value"),
        F.when(matched, F.when(F.col("known"), F.col("payment_type")).otherwise(first_class))
         .otherwise(F.lit("boleto")).alias("payment_type"),
        F.when(matched, F.coalesce(F.dayofweek("order_purchase_timestamp") - 1, F.lit(0))).otherwise(0)
         .alias("day_of_week"),
        F.when(matched & (kg >= RU.BULKY_KG), "bulky_single_piece").otherwise("standard")
         .alias("handling_category"),
        F.when(matched, F.col("seller_id")).otherwise("UNKNOWN").alias("seller_id"))


@register("prefix_lookup_order", with_views("""
SELECT f.position, f.focus_id, r.rn IS NOT NULL AS matched,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.product_weight_g / CAST(1000.0 AS DOUBLE), 1.5) ELSE 1.5 END AS weight_kg,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.payment_value, 150.0) ELSE 150.0 END AS order_value,
       CASE WHEN r.rn IS NOT NULL THEN (CASE WHEN r.payment_type IN (SELECT payment_type FROM cls)
                                             THEN r.payment_type ELSE (SELECT min(payment_type) FROM cls) END)
            ELSE 'boleto' END AS payment_type,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(CAST(dayofweek(r.order_purchase_timestamp) AS INTEGER), 0) ELSE 0 END AS day_of_week,
       CASE WHEN r.rn IS NOT NULL AND coalesce(r.product_weight_g / CAST(1000.0 AS DOUBLE), 1.5) >= 15.0
            THEN 'bulky_single_piece' ELSE 'standard' END AS handling_category,
       CASE WHEN r.rn IS NOT NULL THEN r.seller_id ELSE 'UNKNOWN' END AS seller_id
FROM flist f LEFT JOIN (
  SELECT * FROM (
    SELECT fl.focus_id, o.order_purchase_timestamp, i.seller_id, p.payment_value, p.payment_type,
           pr.product_weight_g,
           row_number() OVER (PARTITION BY fl.focus_id ORDER BY o.order_id, i.order_item_id, i.product_id,
                              i.seller_id, p.payment_sequential) AS rn
    FROM b_orders_base o JOIN flist fl ON substr(o.order_id, 1, 12) = fl.focus_id
    JOIN b_items i ON o.order_id = i.order_id JOIN b_payments p ON o.order_id = p.order_id
    JOIN b_products pr ON i.product_id = pr.product_id) t WHERE rn = 1) r ON f.focus_id = r.focus_id
""", FOCUS_ORDERS_CTES + f", rb AS ({RISK_BASE_SQL}), cls AS (SELECT DISTINCT payment_type FROM rb "
                         "WHERE payment_type IS NOT NULL)"))
def prefix_lookup_order_q(spark, d):
    b = from_testdata(spark, d)
    return prefix_lookup_order(b, focus_orders(b, spark, d))


def prefix_lookup_customer(b: Biz, ids: DataFrame) -> DataFrame:
    ids = F.broadcast(ids)
    o = b.orders.join(ids.select("focus_id"), F.substring("customer_id", 1, 12) == ids.focus_id)
    keyed = o.select("customer_id", "focus_id").distinct()
    agg = FE._churn_aggregate(dataclasses.replace(b, orders=o.drop("focus_id")), delivered_only=False)
    from pyspark.sql import Window
    w = Window.partitionBy("focus_id").orderBy("customer_id")
    first = (agg.join(keyed, "customer_id").withColumn("rn", F.row_number().over(w)).where("rn = 1"))
    j = ids.join(first, "focus_id", "left")
    m = F.col("rn").isNotNull()
    return j.select(
        "position", "focus_id", m.alias("matched"),
        F.when(m, F.col("frequency")).otherwise(1).alias("frequency"),
        F.when(m, F.coalesce("monetary", F.lit(500.0))).otherwise(500.0).alias("monetary"),
        F.when(m, F.coalesce("avg_review_score", F.lit(3.0))).otherwise(3.0).alias("avg_review_score"),
        F.when(m, F.coalesce("avg_freight_value", F.lit(50.0))).otherwise(25.0).alias("avg_freight_value"),
        F.when(m, F.coalesce("avg_delivery_delay", F.lit(0.0))).otherwise(2.0).alias("avg_delivery_delay"),
        F.lit(95).alias("days_since_last"), F.lit(3).alias("days_since_delivery"))


@register("prefix_lookup_customer", with_views("""
SELECT f.position, f.focus_id, r.rn IS NOT NULL AS matched,
       CASE WHEN r.rn IS NOT NULL THEN r.frequency ELSE 1 END AS frequency,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.monetary, 500.0) ELSE 500.0 END AS monetary,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.avg_review_score, 3.0) ELSE 3.0 END AS avg_review_score,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.avg_freight_value, 50.0) ELSE 25.0 END AS avg_freight_value,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.avg_delivery_delay, 0.0) ELSE 2.0 END AS avg_delivery_delay,
       95 AS days_since_last, 3 AS days_since_delivery
FROM flist f LEFT JOIN (
  SELECT * FROM (SELECT fl.focus_id, a.*, row_number() OVER (PARTITION BY fl.focus_id ORDER BY a.customer_id) AS rn
                 FROM cagg a JOIN flist fl ON substr(a.customer_id, 1, 12) = fl.focus_id) t
  WHERE rn = 1) r ON f.focus_id = r.focus_id
""", FOCUS_CUSTOMERS_CTES + f", cagg AS ({churn_agg_sql(delivered_only=False)})"))
def prefix_lookup_customer_q(spark, d):
    b = from_testdata(spark, d)
    return prefix_lookup_customer(b, focus_customers(b, spark, d))


def prefix_lookup_seller(b: Biz, ids: DataFrame) -> DataFrame:
    ids = F.broadcast(ids)
    it = b.items.join(ids.select("focus_id"), F.substring("seller_id", 1, 8) == ids.focus_id)
    keyed = it.select("seller_id", "focus_id").distinct()
    agg = FE.seller_aggregate(dataclasses.replace(b, items=it.drop("focus_id")), for_serving=True)
    from pyspark.sql import Window
    w = Window.partitionBy("focus_id").orderBy("seller_id")
    first = agg.join(keyed, "seller_id").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    j = ids.join(first, "focus_id", "left")
    m = F.col("rn").isNotNull()
    return j.select(
        "position", "focus_id", m.alias("matched"),
        F.when(m, F.col("total_orders")).otherwise(50).alias("total_orders"),
        F.when(m, F.coalesce("avg_rating", F.lit(4.0))).otherwise(4.0).alias("avg_rating"),
        F.when(m, F.coalesce("avg_order_value", F.lit(150.0))).otherwise(150.0).alias("avg_order_value"),
        F.when(m, F.coalesce("avg_delay_days", F.lit(0.0))).otherwise(-5.0).alias("avg_delay_days"),
        F.when(m, F.coalesce("cancellation_rate", F.lit(0.0))).otherwise(0.02).alias("cancellation_rate"),
        F.lit(5).alias("price_increase"), F.lit(0.01).alias("return_rate"),
        F.lit(45).alias("days_on_platform"))


@register("prefix_lookup_seller", with_views("""
SELECT f.position, f.focus_id, r.rn IS NOT NULL AS matched,
       CASE WHEN r.rn IS NOT NULL THEN r.total_orders ELSE 50 END AS total_orders,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.avg_rating, 4.0) ELSE 4.0 END AS avg_rating,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.avg_order_value, 150.0) ELSE 150.0 END AS avg_order_value,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.avg_delay_days, 0.0) ELSE -5.0 END AS avg_delay_days,
       CASE WHEN r.rn IS NOT NULL THEN coalesce(r.cancellation_rate, 0.0) ELSE 0.02 END AS cancellation_rate,
       5 AS price_increase, 0.01 AS return_rate, 45 AS days_on_platform
FROM flist f LEFT JOIN (
  SELECT * FROM (SELECT fl.focus_id, a.*, row_number() OVER (PARTITION BY fl.focus_id ORDER BY a.seller_id) AS rn
                 FROM sagg a JOIN flist fl ON substr(a.seller_id, 1, 8) = fl.focus_id) t
  WHERE rn = 1) r ON f.focus_id = r.focus_id
""", FOCUS_SELLERS_CTES + f", sagg AS ({seller_agg_sql(having=False)})"))
def prefix_lookup_seller_q(spark, d):
    b = from_testdata(spark, d)
    return prefix_lookup_seller(b, focus_sellers(b, spark, d))


# ---------------------------------------------------------------- actions and audit


def decisions(b: Biz, scores: DataFrame | None = None) -> DataFrame:
    """Open orders scored 70+ get an action by score band (our policy):
    90+ lock the seller, 80+ change hub, else open a ticket. ``scores``: (order_id,
    risk_score) of a fitted model, or the stand-in."""
    if scores is None:
        s = RP.order_score(b).withColumn("tenths", (F.col("o_orderkey") * 37) % 1000)
    else:
        s = scores.select("order_id", F.floor(F.col("risk_score") * 10).alias("tenths"))
    x = F.col("tenths")
    o = (b.orders_nodates.where(F.col("order_status").isin(*RP.OPEN_STATUSES))
         .select("order_id", "order_purchase_timestamp").join(s, "order_id")
         .where(x >= 700))
    first_seller = (b.items.groupBy("order_id")
                    .agg(F.min(F.struct("order_item_id", "product_id", "seller_id"))["seller_id"]
                         .alias("seller_id")))
    act = F.when(x >= 900, "lock_seller").when(x >= 800, "change_hub").otherwise("open_ticket")
    return o.join(first_seller, "order_id").select(
        "order_id", "seller_id", act.alias("action"), x.alias("risk_score_tenths"),
        F.col("order_purchase_timestamp").alias("decided_at"))


def _sql_lit(s):
    return "'" + s.replace("'", "''") + "'"


ACTION_EVENT_SQL = f"""
SELECT order_id, seller_id, action, severity, CAST(x AS DOUBLE) / CAST(10.0 AS DOUBLE) AS risk_score,
       strftime(decided_at + INTERVAL 7 HOUR, '%H:%M:%S') AS "timestamp",
       '{{"order_id": "' || order_id || '", "risk_score": ' || CAST(x // 10 AS VARCHAR) || '.' ||
       CAST(x % 10 AS VARCHAR) || ', "type": "' || severity || '", "message": "' ||
       {_sql_lit(MSG_ACTION[0])} || upper(action) || {_sql_lit(MSG_ACTION[1])} || order_id ||
       {_sql_lit(MSG_ACTION[2])} || seller_id || {_sql_lit(MSG_ACTION[3])} ||
       '", "timestamp": "' || strftime(decided_at + INTERVAL 7 HOUR, '%H:%M:%S') || '"}}' AS payload,
       'alert_history' AS channel
FROM (
  SELECT o.order_id, fs.seller_id, o.x, o.order_purchase_timestamp AS decided_at,
         CASE WHEN o.x >= 900 THEN 'lock_seller' WHEN o.x >= 800 THEN 'change_hub' ELSE 'open_ticket' END AS action,
         CASE WHEN o.x >= 800 THEN 'critical' ELSE 'warning' END AS severity
  FROM (SELECT order_id, order_purchase_timestamp, o_orderkey * 37 % 1000 AS x FROM b_orders_base
        WHERE order_status IN ('processing', 'shipped')) o
  JOIN (SELECT order_id, seller_id FROM (
          SELECT order_id, seller_id,
                 row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, product_id, seller_id) AS rn
          FROM b_items) t WHERE rn = 1) fs ON o.order_id = fs.order_id
  WHERE o.x >= 700) d
"""


@register("action_event", with_views(ACTION_EVENT_SQL))
def action_event(spark, d):
    return AC.action_events(decisions(from_testdata(spark, d)))


@register("action_writeback", with_views(f"""
SELECT seq, raw FROM (
  SELECT seq, raw FROM raw UNION ALL
  SELECT (SELECT max(seq) FROM raw) + row_number() OVER (ORDER BY order_id), payload FROM ev) f
ORDER BY seq DESC LIMIT {AL.FEED_LIMIT}
""", ALERT_CTES + f", ev AS ({ACTION_EVENT_SQL})"))
def action_writeback(spark, d):
    """The events of confirmed actions are appended to the event table, one
    partition a channel, read back, and pushed to the feed in the order of their ids, as
    one segment that follows all others. Only the newest events can stay, so only those
    are numbered."""
    from pyspark.sql import Window

    base = scratch_dir(spark, f"events/{uuid.uuid4().hex}")
    AC.action_events(decisions(from_testdata(spark, d))).write.mode("append").partitionBy("channel").parquet(f"{base}/table")
    events = spark.read.parquet(f"{base}/table").where(F.col("channel") == AC.CHANNEL)
    log = FeedLog(spark, f"{base}/feed", FEED_SCHEMA)
    log.push(raw_alerts(spark, d), 1)
    last = max((s.most for s in log.segments() if s.most > OLDEST), default=0) + events.count()
    newest = events.orderBy(F.col("order_id").desc()).limit(AL.FEED_LIMIT)
    number = F.lit(last + 1).cast("long") - F.row_number().over(Window.orderBy(F.col("order_id").desc()))
    log.push(newest.select(number.alias("seq"), F.col("payload").alias("raw")), 2)
    log.trim(AL.FEED_LIMIT)
    return log.newest(AL.FEED_LIMIT)


_CHURN_RULES_BODY = RP.CHURN_RULES_BODY
_SELLER_RULES_BODY = RP.SELLER_RULES_BODY


@register("audit_trail", with_views(f"""
SELECT 'customer' AS entity_type, customer_id AS entity_id, rule AS action,
       strftime({RP.ASOF_SQL} + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS "timestamp",
       'AWAITING_APPROVAL' AS status
FROM ({_CHURN_RULES_BODY}) c
UNION ALL
SELECT 'seller', seller_id, rule, strftime({RP.ASOF_SQL} + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S'), 'PENDING'
FROM ({_SELLER_RULES_BODY}) s
""", RP.CHURN_RULE_CTES + RP.SELLER_RULE_CTES))
def audit_trail(spark, d):
    """The records are appended to the audit table, a partition a day, and read back."""
    from tradewind.operators.inputs import as_of
    b = from_testdata(spark, d)
    at = as_of(b)
    c = AC.audit_records(RU.churn_rules(RP.churn_rule_table(b)), "customer", "customer_id",
                         "AWAITING_APPROVAL", at)
    s = AC.audit_records(RU.seller_rules(RP.seller_rule_table(b)), "seller", "seller_id", "PENDING", at)
    path = scratch_dir(spark, f"audit/{uuid.uuid4().hex}")
    AC.append_audit(c.unionByName(s), path, "run-1")
    return AC.read_audit(spark, path)
