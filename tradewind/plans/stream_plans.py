"""Streaming queries: alert stream, monitor and snapshot, action cooldown.

Each query lands its input as files in the shared checkpoint folder, runs
the streaming job with an ``availableNow`` trigger (all arrived data, then
stop) and returns the sink's table. The same jobs run continuously with a
processing-time trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradewind.operators import actions as AC
from tradewind.operators import alerts as AL
from tradewind.operators import ml as ML
from tradewind.plans import ml_plans as MP
from tradewind.plans.alert_plans import ALERT_CTES, ENTITY_SQL, PARSED_COLS
from tradewind.plans.catalog import register
from tradewind.plans.oracle_views import with_views
from tradewind.session import DROP_SHUFFLES, scratch_dir, written
from tradewind.sources.alert_source import raw_alerts
from tradewind.sources.business import from_testdata
from tradewind.streaming import alert_stream as AS
from tradewind.streaming import change_monitor as CM
from tradewind.streaming import cooldown as CS
from tradewind.streaming import monitor as MO

ARRIVALS = 3


def _slices(df, order_col):
    """The rows cut into ``ARRIVALS`` time slices, in arrival order; rows without a time
    come with the first."""
    at = df.select(F.percentile_approx(order_col, [i / ARRIVALS for i in range(1, ARRIVALS)])).first()[0] or []
    c = F.col(order_col)
    bounds = [None, *at, None]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        after = (c > lo) if lo is not None else F.lit(True)
        until = (c <= hi) if hi is not None else F.lit(True)
        yield df.where((after & until) | c.isNull() if lo is None else after & until)


def _arrive(df, order_col, path, start):
    """Land one slice after the other and let the stream (same checkpoint) take each as it comes."""
    for part in _slices(df, order_col):
        part.write.mode("append").parquet(path)
        _run(start())


def _run(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))


@register("alert_stream", with_views(f"SELECT {PARSED_COLS} FROM parsed", ALERT_CTES))
def alert_stream(spark, d):
    """T1 + T2: parse the arriving feed into the alert table and keep the
    bounded newest-500 store; returns the alert table (= batch alert_parse)."""
    base = scratch_dir(spark, f"streams/{uuid.uuid4().hex}")
    for part in _slices(raw_alerts(spark, d), "seq"):
        part.write.mode("append").parquet(f"{base}/in")
        stream = AS.read_alert_stream(spark, f"{base}/in", files_per_trigger=1000)
        _run(AS.start_parse_sink(stream, f"{base}/alerts", f"{base}/ckpt_alerts"))
        _run(AS.start_bounded_store(stream, f"{base}/store", f"{base}/ckpt_store"))
    return spark.read.parquet(f"{base}/alerts")


ORDER, CUSTOMER = "order", "customer"
#: Changes for each bucket of the monitor's state (fixed when its first one is written).
CHANGES_PER_STATE_PARTITION = 1_000_000


def _watch(spark, log, flag, order_col="event_time"):
    """Land the change log slice by slice, let the monitor take each, return its snapshots' folder."""
    base = scratch_dir(spark, f"streams/{uuid.uuid4().hex}")
    log = written(log)  # read once for each slice
    own = spark.newSession()  # the stream's settings are its own
    own.conf.set(DROP_SHUFFLES, "true")
    parts = max(spark.sparkContext.defaultParallelism, -(-log.count() // CHANGES_PER_STATE_PARTITION))
    schema = log.schema
    _arrive(log, order_col, f"{base}/in", lambda: CM.start_change_monitor(
        own.readStream.schema(schema).parquet(f"{base}/in"), flag, f"{base}/snapshot", f"{base}/ckpt", state_partitions=parts))
    return f"{base}/snapshot"


def model_changes(spark, d):
    """A change for each open order and customer, with what the models score."""
    b = from_testdata(spark, d)
    orders = ML.open_order_features(b).join(b.orders_nodates.select("order_id", F.col("order_purchase_timestamp").alias("event_time")), "order_id")
    orders = orders.select(F.lit(ORDER).alias("kind"), F.col("order_id").alias("entity_id"), "event_time", "product_weight_g", "order_value",
                           "day_of_week", "payment_type")
    customers = ML.customer_serving_features(b).select(F.lit(CUSTOMER).alias("kind"), F.col("customer_id").alias("entity_id"), *ML.CHURN_INPUTS)
    return orders.unionByName(customers, allowMissingColumns=True).withColumns({"seq": F.lit(1).cast("long"), "closing": F.lit(False)})


def model_flag(spark, d):
    """Changed rows scored by the fitted models."""
    risk, churn = MP.risk_model(spark, d)[0], MP.churn_model(spark, d)[0]
    columns = ("kind", "entity_id", "seq", "closing", "event_time", "flag")

    def flag(rows):
        score = ML.prob1() * 100.0
        orders = risk.transform(rows.where(F.col("kind") == ORDER).withColumn("payment_type", ML.known_payment(risk)))
        customers = churn.transform(rows.where(F.col("kind") == CUSTOMER))
        return (orders.withColumn("flag", score > MP.RISK_ALERT).select(*columns)
                .unionByName(customers.withColumn("flag", score > MP.CHURN_ALERT).select(*columns)))
    return flag


def _model_totals(spark, d):
    return CM.read_totals(spark, _watch(spark, model_changes(spark, d), model_flag(spark, d)))


@register("monitor_stream")
def monitor_stream(spark, d):
    """Counts published by the change monitor over the fitted models' scores (raw snapshot text)."""
    return CM.kpi_text(_model_totals(spark, d), ORDER, CUSTOMER)


@register("kpi_snapshot")
def kpi_snapshot(spark, d):
    """The last published snapshot, fields defaulted when missing."""
    base = scratch_dir(spark, f"streams/{uuid.uuid4().hex}/kpi")
    monitor_stream(spark, d).write.mode("overwrite").text(AS.generation_path(base, 0))
    return MO.read_snapshot(spark, base)


# Inserts, changes and closings by rule, with stand-in scores in tenths; the last change of an entity counts.
_CHANGES_SQL = f""", chg AS (
  SELECT '{ORDER}' AS kind, order_id AS entity_id, 1 AS seq, false AS closing, o_orderkey * 37 % 1000 > 700 AS flag FROM b_orders_base
  UNION ALL SELECT '{ORDER}', order_id, 2, false, o_orderkey * 91 % 1000 > 700 FROM b_orders_base WHERE o_orderkey % 3 = 0
  UNION ALL SELECT '{ORDER}', order_id, 3, true, false FROM b_orders_base WHERE order_status NOT IN ('processing', 'shipped')
  UNION ALL SELECT '{CUSTOMER}', customer_id, 1, false, c_custkey * 53 % 1000 > 500 FROM b_customers
  UNION ALL SELECT '{CUSTOMER}', customer_id, 2, false, c_custkey * 77 % 1000 > 500 FROM b_customers WHERE c_custkey % 2 = 0
), last AS (SELECT kind, entity_id, max_by(flag, seq) AS flag, max_by(closing, seq) AS closing FROM chg GROUP BY kind, entity_id)
"""


def rule_changes(spark, d):
    """A change log of all orders and customers: inserts, changed scores, closings."""
    b = from_testdata(spark, d)
    at = F.col("order_purchase_timestamp")
    o = b.orders_nodates.select(F.lit(ORDER).alias("kind"), F.col("order_id").alias("entity_id"), F.col("o_orderkey").alias("k"), "order_status", at)
    c = b.customers.select(F.lit(CUSTOMER).alias("kind"), F.col("customer_id").alias("entity_id"), F.col("c_custkey").alias("k"))
    day = lambda n: at + F.expr(f"INTERVAL {n} DAYS")

    def change(rows, seq, tenths, event_time, closing=False):
        return rows.select("kind", "entity_id", F.lit(seq).cast("long").alias("seq"), F.lit(closing).alias("closing"),
                           tenths.cast("int").alias("tenths"), event_time.cast("timestamp_ntz").alias("event_time"))

    parts = [change(o, 1, F.col("k") * 37 % 1000, day(0)), change(o.where("k % 3 = 0"), 2, F.col("k") * 91 % 1000, day(40)),
             change(o.where("order_status NOT IN ('processing', 'shipped')"), 3, F.lit(None), day(80), True),
             change(c, 1, F.col("k") * 53 % 1000, F.lit(None)), change(c.where("k % 2 = 0"), 2, F.col("k") * 77 % 1000, F.lit("1995-06-01"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rule_flag(rows):
    limit = F.when(F.col("kind") == ORDER, MP.RISK_ALERT * 10).otherwise(MP.CHURN_ALERT * 10)
    return rows.withColumn("flag", F.col("tenths") > limit)


@register("monitor_changes", with_views(
    "SELECT kind, CAST(count(*) FILTER (WHERE flag AND NOT closing) AS BIGINT) AS flagged, CAST(count(*) FILTER (WHERE NOT closing) AS BIGINT) AS open, "
    "(SELECT count(*) FROM chg c WHERE c.kind = l.kind AND NOT c.closing) AS scored FROM last l GROUP BY kind", _CHANGES_SQL))
def monitor_changes(spark, d):
    """Counts moved by signed differences; as many rows scored as changed."""
    return CM.read_totals(spark, _watch(spark, rule_changes(spark, d), rule_flag)).drop("us")


# The chain of passed requests, followed request by request.
COOLDOWN_SQL = with_views("""
SELECT q.entity_id, q.action, q.ts, p.t IS NOT NULL AND q.copy = 1 AS allowed
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, action, ts) AS copy FROM req) q
LEFT JOIN passed p ON p.e = q.entity_id AND p.a = q.action AND p.t = q.ts
""", ALERT_CTES + f""", req AS (
  SELECT * FROM (SELECT {ENTITY_SQL} AS entity_id, route AS action, event_time AS ts FROM routed) x WHERE entity_id IS NOT NULL
), passed(e, a, t) AS (
  SELECT entity_id, action, min(ts) FROM req GROUP BY entity_id, action
  UNION ALL
  SELECT p.e, p.a, min(r.ts) FROM passed p JOIN req r ON r.entity_id = p.e AND r.action = p.a AND r.ts >= p.t + INTERVAL {AC.COOLDOWN_HOURS} HOUR
  GROUP BY p.e, p.a
)""").replace("WITH", "WITH RECURSIVE", 1)


def cooldown_requests(spark, d):
    """Action requests from the alert feed: (entity, alert class, time)."""
    r = AL.with_entity(AL.with_route(AL.parse_alerts(raw_alerts(spark, d))))
    return r.where(F.col("entity_id").isNotNull()).select(
        "entity_id", F.col("route").alias("action"), F.col("event_time").alias("ts"))


@register("action_cooldown", COOLDOWN_SQL)
def action_cooldown(spark, d):
    """T5 / X7 batch form: greedy 24 h cooldown per (entity, action)."""
    return AC.cooldown(cooldown_requests(spark, d))


@register("action_cooldown_stream", COOLDOWN_SQL)
def action_cooldown_stream(spark, d):
    """T5 / X7 stream form: micro-batches against the passed requests that still count."""
    base = scratch_dir(spark, f"streams/{uuid.uuid4().hex}")

    def start():
        stream = spark.readStream.schema("entity_id string, action string, ts timestamp_ntz").parquet(f"{base}/in")
        return CS.start_cooldown(stream, f"{base}/out", f"{base}/state", f"{base}/ckpt")

    _arrive(cooldown_requests(spark, d), "ts", f"{base}/in", start)
    return CS.read_results(spark, f"{base}/out").drop("late")
