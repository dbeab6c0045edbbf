"""The alert feed as a table of raw JSON text, derived from ``events``.

The reference keeps alerts as JSON strings in a list, newest first. Here
the feed is an append-only table ``(seq, event_time, raw)``; "newest" means
highest ``seq``. Each event becomes one alert whose kind follows its
``event_type`` (our mapping); every 50th event is malformed text, and
``error`` events cover the parse edge cases (no message, null message,
numeric message, free text).
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.sources.tables import read_table


def _ascii(text: str) -> str:
    """A fixed text as it appears inside ``json.dumps`` output (\\u escapes)."""
    return json.dumps(text)[1:-1]


# Fixed message parts (routing words are the reference's).
MSG_DELIVERY = (_ascii("Đơn `"), _ascii("` có rủi ro giao trễ"))
MSG_CHURN = (_ascii("[CHURN] Khách `"), _ascii("` sắp rời bỏ"))
MSG_SELLER = (_ascii("Seller `"), _ascii("` vi phạm vận hành"))
MSG_ACTION = (_ascii("[CEO ACTION] Đã ra lệnh "), _ascii(" cho Đơn `"), _ascii("` / Seller `"), "`")
MSG_WEATHER = _ascii("Thời tiết xấu tại kho trung chuyển")
MALFORMED_EVERY = 50


def _id(tag: str, key: Column) -> Column:
    return key.cast("string")


def score_text(c: Column) -> Column:
    """One-decimal score text for an integer ``c`` in tenths (e.g. ``90.0``),
    the way Python prints such a float."""
    return F.concat(F.floor(c / 10).cast("string"), F.lit("."), (c % 10).cast("string"))


_LANDED: dict = {}
_LOCK = threading.Lock()


def raw_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The alert feed table for data folder ``d``.

    The feed is a stored table in production; here it is derived from
    ``events`` once per process and data folder, written as parquet under
    the shared checkpoint folder, and read back by every alert query.
    """
    key = (spark.sparkContext.applicationId, d)
    with _LOCK:
        path = _land_feed(spark, d, key)
    return spark.read.parquet(path)


def _land_feed(spark: SparkSession, d: str, key) -> str:
    from tradewind.session import scratch_dir
    import uuid
    path = _LANDED.get(key)
    if path is None:
        path = scratch_dir(spark, f"alert_feed/{uuid.uuid4().hex}")
        feed = build_raw_alerts(spark, d)
        slots = spark.sparkContext.defaultParallelism
        if feed.rdd.getNumPartitions() < slots:  # spread a small source over all task slots
            feed = feed.repartitionByRange(slots, "seq")
        feed.write.mode("overwrite").parquet(path)
        _LANDED[key] = path
    return path


def build_raw_alerts(spark: SparkSession, d: str) -> DataFrame:
    ev = read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    eid, uid = F.col("event_id"), F.col("user_id")
    x = (eid * 37) % 1000
    # Shared parts as columns first: the JSON text below refers to them, so
    # each hash / format is computed once per row and the generated code of
    # the big CASE stays small.
    ev = ev.select("event_id", "ts", "event_type",
                   score_text(x).alias("_score"),
                   F.date_format(F.col("ts") + F.expr("INTERVAL 7 HOURS"), "HH:mm:ss").alias("_clock"),
                   _id("order", eid).alias("_oid"), _id("customer", uid).alias("_cid"),
                   _id("seller", uid).alias("_sid"),
                   F.when(x >= 700, "critical").otherwise("warning").alias("_sev"))
    score, clock = F.col("_score"), F.col("_clock")
    oid, cid, sid, sev = F.col("_oid"), F.col("_cid"), F.col("_sid"), F.col("_sev")

    def obj(*pairs):
        parts = [F.lit("{")]
        for i, (k, v) in enumerate(pairs):
            parts += [F.lit(("" if i == 0 else ", ") + f'"{k}": '), v]
        parts.append(F.lit("}"))
        return F.concat(*parts)

    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    L = F.lit
    delivery = obj(("order_id", q(oid)), ("risk_score", score), ("type", q(sev)),
                   ("message", q(F.concat(L(MSG_DELIVERY[0]), F.substring(oid, 1, 12), L(MSG_DELIVERY[1])))),
                   ("timestamp", q(clock)))
    churn = obj(("risk_score", score), ("type", q(sev)),
                ("message", q(F.concat(L(MSG_CHURN[0]), cid, L(MSG_CHURN[1])))), ("timestamp", q(clock)))
    seller = obj(("risk_score", score), ("type", q(sev)),
                 ("message", q(F.concat(L(MSG_SELLER[0]), sid, L(MSG_SELLER[1])))), ("timestamp", q(clock)))
    action = obj(("order_id", q(oid)), ("risk_score", score), ("type", q(L("critical"))),
                 ("message", q(F.concat(L(MSG_ACTION[0]), L("LOCK_SELLER"), L(MSG_ACTION[1]), oid,
                                        L(MSG_ACTION[2]), sid, L(MSG_ACTION[3])))),
                 ("timestamp", q(clock)))
    k = eid % 6
    error = (F.when(k == 0, obj(("order_id", q(oid)), ("type", q(L("warning"))), ("timestamp", q(clock))))
              .when(k == 1, obj(("order_id", q(oid)), ("message", L("null"))))
              .when(k == 2, obj(("message", L("42"))))
              .when(k == 3, obj(("order_id", q(oid)), ("message", L('["[CHURN]",5]'))))
              .when(k == 4, obj(("order_id", q(oid)), ("message", L('{"Seller":"x"}'))))
              .otherwise(obj(("type", q(L("warning"))), ("message", q(L(MSG_WEATHER))),
                             ("timestamp", q(clock)))))
    et = F.col("event_type")
    raw = (F.when(eid % MALFORMED_EVERY == 0, F.concat(L("oops{"), eid.cast("string")))
            .when(et == "purchase", delivery).when(et == "view", churn).when(et == "click", seller)
            .when(et == "signup", action).otherwise(error))
    return ev.select(eid.alias("seq"), F.col("ts").alias("event_time"), raw.alias("raw"))


def _sql_id(tag, key):
    return f"CAST({key} AS VARCHAR)"


def raw_alerts_sql() -> str:
    """The same feed as a DuckDB CTE body."""
    x = "((event_id * 37) % 1000)"
    score = f"(CAST({x} // 10 AS VARCHAR) || '.' || CAST({x} % 10 AS VARCHAR))"
    clock = "strftime(ts + INTERVAL 7 HOUR, '%H:%M:%S')"
    oid, cid, sid = _sql_id("order", "event_id"), _sql_id("customer", "user_id"), _sql_id("seller", "user_id")
    sev = f"(CASE WHEN {x} >= 700 THEN 'critical' ELSE 'warning' END)"

    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    def obj(*pairs):
        out = ["'{'"]
        for i, (k, v) in enumerate(pairs):
            out.append(lit(("" if i == 0 else ", ") + f'"{k}": '))
            out.append(v)
        out.append("'}'")
        return "(" + " || ".join(out) + ")"

    def q(v):
        return f"('\"' || {v} || '\"')"

    delivery = obj(("order_id", q(oid)), ("risk_score", score), ("type", q(sev)),
                   ("message", q(f"{lit(MSG_DELIVERY[0])} || substr({oid}, 1, 12) || {lit(MSG_DELIVERY[1])}")),
                   ("timestamp", q(clock)))
    churn = obj(("risk_score", score), ("type", q(sev)),
                ("message", q(f"{lit(MSG_CHURN[0])} || {cid} || {lit(MSG_CHURN[1])}")), ("timestamp", q(clock)))
    seller = obj(("risk_score", score), ("type", q(sev)),
                 ("message", q(f"{lit(MSG_SELLER[0])} || {sid} || {lit(MSG_SELLER[1])}")), ("timestamp", q(clock)))
    action = obj(("order_id", q(oid)), ("risk_score", score), ("type", q("'critical'")),
                 ("message", q(f"{lit(MSG_ACTION[0])} || 'LOCK_SELLER' || {lit(MSG_ACTION[1])} || {oid} || "
                               f"{lit(MSG_ACTION[2])} || {sid} || {lit(MSG_ACTION[3])}")),
                 ("timestamp", q(clock)))
    error = (f"CASE WHEN event_id % 6 = 0 THEN {obj(('order_id', q(oid)), ('type', q(lit('warning'))), ('timestamp', q(clock)))} "
             f"WHEN event_id % 6 = 1 THEN {obj(('order_id', q(oid)), ('message', lit('null')))} "
             f"WHEN event_id % 6 = 2 THEN {obj(('message', lit('42')))} "
             f"WHEN event_id % 6 = 3 THEN {obj(('order_id', q(oid)), ('message', lit('["[CHURN]",5]')))} "
             f"WHEN event_id % 6 = 4 THEN {obj(('order_id', q(oid)), ('message', lit('{"Seller":"x"}')))} "
             f"ELSE {obj(('type', q(lit('warning'))), ('message', q(lit(MSG_WEATHER))), ('timestamp', q(clock)))} END")
    raw = (f"CASE WHEN event_id % {MALFORMED_EVERY} = 0 THEN 'oops{{' || CAST(event_id AS VARCHAR) "
           f"WHEN event_type = 'purchase' THEN {delivery} WHEN event_type = 'view' THEN {churn} "
           f"WHEN event_type = 'click' THEN {seller} WHEN event_type = 'signup' THEN {action} "
           f"ELSE {error} END")
    return f"SELECT event_id AS seq, ts AS event_time, {raw} AS raw FROM events"
