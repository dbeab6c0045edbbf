"""Alert feed operators: parse, route, extract ids, newest-N, focus lists.

Parsing keeps the reference's skip rules (a row is skipped when the text is not
a JSON object, or when ``message`` is there but cannot be searched: null, number,
boolean); a missing ``message`` reads as ''. All of it is
per-row column work: no shuffle until a grouping or ordering is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.text import CUSTOMER_WORD, ORDER_WORD, SELLER_WORD, extract_entity, prefix

FEED_LIMIT = 500  # the feed's bounded history
PER_ROUTE = 10  # newest alerts shown per class
FOCUS_SIZE = 5

# Fixed fallback ids used when nothing else is found (one per page).
FALLBACK_ORDER_ID = "e481f51cbdc5"
FALLBACK_CUSTOMER_ID = "053fbd86c4da"
FALLBACK_SELLER_ID = "729f0699"

def _fields(raw: DataFrame) -> tuple[DataFrame, object, object]:
    """Rows whose text is a JSON object, with it parsed once (``m``); the last value of a
    key as a VARIANT column, and whether the key is there."""
    rows = raw.select("seq", "event_time", F.expr(
        "CASE WHEN rtrim(raw) LIKE '%}' THEN from_json(raw, 'map<string,variant>', map('allowSingleQuotes', 'false')) END").alias("m"))
    keys = F.map_keys("m")

    def there(name):
        return F.array_contains(keys, name)

    def last(name):  # of repeated keys the last counts
        return F.get(F.map_values("m"), F.size(keys) - F.array_position(F.reverse(keys), name).cast("int"))

    return rows.where(F.col("m").isNotNull()), last, there


def _text(value) -> F.Column:
    """A VARIANT as text: a JSON string without its quotes, anything else as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def parse_alerts(raw: DataFrame) -> DataFrame:
    """(seq, event_time, raw) -> parsed alert rows; bad rows are skipped.

    Kept: a JSON object whose ``message`` is missing, a string, an array or an
    object (a null, number or boolean cannot be searched and drops the row). For an
    array ``words`` has its elements and for an object its keys, among which the
    routing words are looked up whole; for a string it is null.
    """
    rows, last, there = _fields(raw)
    fields = ("order_id", "risk_score", "type", "message", "timestamp")
    rows = rows.select("seq", "event_time", *[F.when(there(c), last(c)).alias(c) for c in fields],
                       there("message").alias("has_message"))
    kind = F.coalesce(F.schema_of_variant("message"), F.when(~F.col("has_message"), "STRING"), F.lit("VOID"))
    rows = rows.withColumn("kind", kind).where(
        (F.col("kind") == "STRING") | F.col("kind").startswith("ARRAY") | F.col("kind").startswith("OBJECT"))
    msg = F.coalesce(_text("message"), F.lit(""))
    return rows.select(
        "seq", "event_time", _text("order_id").alias("order_id"),
        _text("risk_score").try_cast("double").alias("risk_score"),
        F.coalesce(_text("type"), F.lit("warning")).alias("type"), msg.alias("message"),
        F.coalesce(_text("timestamp"), F.lit("")).alias("timestamp"),
        F.when(F.col("kind").startswith("ARRAY"), F.from_json(msg, "array<string>"))
        .when(F.col("kind").startswith("OBJECT"), F.json_object_keys(msg)).alias("words"))


ALERT_COLUMNS = ["seq", "event_time", "order_id", "risk_score", "type", "message", "timestamp"]


def feed_order_ids(raw: DataFrame) -> DataFrame:
    """(seq, order_id) of every JSON object that has an order_id, whatever its message is."""
    rows, last, there = _fields(raw)
    return rows.where(there("order_id")).select("seq", _text(last("order_id")).alias("order_id"))


def has_word(word: str) -> F.Column:
    """Whether the message holds the word: inside a string, or as a whole element or key."""
    return F.coalesce(F.array_contains("words", word), F.col("message").contains(word))


def route(msg: F.Column) -> F.Column:
    """Churn if ``[CHURN]`` or the customer word; else seller; else delivery."""
    return (F.when(msg.contains("[CHURN]") | msg.contains(CUSTOMER_WORD), "churn")
             .when(msg.contains(SELLER_WORD), "seller").otherwise("delivery"))


def with_route(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("route", F.when(has_word("[CHURN]") | has_word(CUSTOMER_WORD), "churn")
                             .when(has_word(SELLER_WORD), "seller").otherwise("delivery"))


def with_entity(routed: DataFrame) -> DataFrame:
    """Id after the class word of the alert's own class (null if none, or if the
    message is no text)."""
    m = F.when(F.col("words").isNull(), F.col("message"))
    r = F.col("route")
    ent = (F.when((r == "churn") & m.contains(CUSTOMER_WORD), extract_entity(m, CUSTOMER_WORD))
            .when((r == "seller") & m.contains(SELLER_WORD), extract_entity(m, SELLER_WORD))
            .when((r == "delivery") & m.contains(ORDER_WORD), extract_entity(m, ORDER_WORD)))
    return routed.withColumn("entity_id", ent)


def newest_raw(raw: DataFrame, n: int = FEED_LIMIT) -> DataFrame:
    """Newest ``n`` feed rows (TakeOrderedAndProject: per-task top-n, then merge)."""
    return raw.orderBy(F.col("seq").desc()).limit(n)


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n"))


def top_per_route(routed: DataFrame, k: int = PER_ROUTE) -> DataFrame:
    """Newest k per class; Spark plans this with a WindowGroupLimit so each
    task keeps only k rows per class before the shuffle."""
    w = Window.partitionBy("route").orderBy(F.col("seq").desc())
    return routed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ---------------------------------------------------------------- focus lists

def focus_list(alert_ids: DataFrame, warehouse_ids: DataFrame, fallback: str,
               size: int = FOCUS_SIZE) -> DataFrame:
    """Alert ids first (feed order), then warehouse ids, distinct, first ``size``.

    Inputs carry (id, pos). Distinct keeps each id's best (priority, pos),
    which is order-preserving de-duplication. Inputs are bounded (the feed's
    500 rows and a newest-N cut), so the final ordering is over few rows.
    """
    cand = (alert_ids.select("id", F.lit(0).alias("pri"), "pos")
            .unionByName(warehouse_ids.select("id", F.lit(1).alias("pri"), "pos"))
            .where(F.col("id").isNotNull()))
    best = cand.groupBy("id").agg(F.min(F.struct("pri", "pos")).alias("k"))
    top = best.orderBy("k.pri", "k.pos").limit(size)
    ranked = top.select(F.row_number().over(Window.orderBy("k.pri", "k.pos")).alias("position"),
                        F.col("id").alias("focus_id"))
    if ranked.isEmpty():
        return ranked.sparkSession.createDataFrame([(1, fallback)], "position int, focus_id string")
    return ranked


def alert_order_ids(newest: DataFrame) -> DataFrame:
    return feed_order_ids(newest).where(F.col("order_id").isNotNull()).select(
        prefix("order_id", 12).alias("id"), (-F.col("seq")).alias("pos"))


def alert_customer_ids(parsed_newest: DataFrame) -> DataFrame:
    m = F.when(F.col("words").isNull(), F.col("message"))
    return (parsed_newest.where(m.contains("[CHURN]") | m.contains(CUSTOMER_WORD))
            .select(prefix(extract_entity(m, CUSTOMER_WORD), 12).alias("id"), (-F.col("seq")).alias("pos")))


def alert_seller_ids(parsed_newest: DataFrame) -> DataFrame:
    m = F.when(F.col("words").isNull(), F.col("message"))
    return (parsed_newest.where(m.contains(SELLER_WORD))
            .select(prefix(extract_entity(m, SELLER_WORD), 8).alias("id"), (-F.col("seq")).alias("pos")))


def needed(alert_ids: DataFrame, size: int = FOCUS_SIZE) -> int:
    """How many warehouse ids the page asks for (0 when alerts suffice)."""
    n = alert_ids.where(F.col("id").isNotNull()).select("id").distinct().count()
    return max(0, size - n)
