"""Action events, audit records and the per-entity cooldown.

An action event is the JSON payload the reference pushes to the alert feed
when an action is confirmed. Here the decisions are a table (one row per
order and action) and the payload is built per row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.session import scratch_dir
from tradewind.sources.alert_source import MSG_ACTION

CRITICAL_ACTIONS = ("lock_seller", "change_hub")
CHANNEL = "alert_history"
LOCAL_OFFSET_HOURS = 7
COOLDOWN_HOURS = 24


def severity(action: F.Column) -> F.Column:
    return F.when(action.isin(*CRITICAL_ACTIONS), "critical").otherwise("warning")


def json_text(c: F.Column) -> F.Column:
    """A string as it stands between the quotes of what ``json.dumps`` writes: everything
    beyond printable ASCII as \\uXXXX of its UTF-16 units, in lower-case digits."""
    quoted = F.to_json(F.array(c))
    inner = F.substring(quoted, F.lit(3), F.length(quoted) - 4)
    units = lambda ch: F.lower(F.hex(F.encode(ch, "UTF-16BE")))
    def escaped(ch):
        u = units(ch)
        return F.when(F.length(u) == 8, F.concat(F.lit("\\u"), F.substring(u, 1, 4), F.lit("\\u"), F.substring(u, 5, 4))).otherwise(F.concat(F.lit("\\u"), u))
    ascii_only = F.array_join(F.transform(F.split(inner, ""), lambda ch: F.when(ch.rlike(r"^[\x00-\x7E]$"), ch).otherwise(escaped(ch))), "")
    wide = F.when(inner.rlike(r"[^\x00-\x7E]"), ascii_only).otherwise(inner)
    # Control characters without a short form: the JSON writer's digits are upper-case.
    return F.when(wide.contains("\\u00"), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        wide, r"(?<!\\)((?:\\\\)*\\u00[01])A", "$1a"), r"(?<!\\)((?:\\\\)*\\u00[01])B", "$1b"), r"(?<!\\)((?:\\\\)*\\u00[01])C", "$1c"),
        r"(?<!\\)((?:\\\\)*\\u00[01])D", "$1d"), r"(?<!\\)((?:\\\\)*\\u00[01])E", "$1e"), r"(?<!\\)((?:\\\\)*\\u00[01])F", "$1f")).otherwise(wide)


def action_events(decisions: DataFrame) -> DataFrame:
    """decisions(order_id, seller_id, action, risk_score_tenths, decided_at) ->
    payload rows. The payload text is what ``json.dumps`` writes for the
    reference's dict (key order, separators, \\u escapes, float text)."""
    sev = severity(F.col("action"))

    text = json_text
    order, seller = text(F.col("order_id")), text(F.col("seller_id"))
    score_txt = F.concat(F.floor(F.col("risk_score_tenths") / 10).cast("string"), F.lit("."),
                         (F.col("risk_score_tenths") % 10).cast("string"))
    clock = F.date_format(F.col("decided_at") + F.expr(f"INTERVAL {LOCAL_OFFSET_HOURS} HOURS"), "HH:mm:ss")
    msg_json = F.concat(F.lit(MSG_ACTION[0]), text(F.upper("action")), F.lit(MSG_ACTION[1]), order,
                        F.lit(MSG_ACTION[2]), seller, F.lit(MSG_ACTION[3]))
    payload = F.concat(F.lit('{"order_id": "'), order, F.lit('", "risk_score": '), score_txt,
                       F.lit(', "type": "'), sev, F.lit('", "message": "'), msg_json,
                       F.lit('", "timestamp": "'), clock, F.lit('"}'))
    return decisions.select("order_id", "seller_id", "action", sev.alias("severity"),
                            (F.col("risk_score_tenths") / F.lit(10.0)).alias("risk_score"),
                            clock.alias("timestamp"), payload.alias("payload"),
                            F.lit(CHANNEL).alias("channel"))


def audit_records(hits: DataFrame, entity_type: str, key: str, status: str,
                  at: F.Column) -> DataFrame:
    """(entity, action, local time text, status) per rule hit."""
    ts = F.date_format(at + F.expr(f"INTERVAL {LOCAL_OFFSET_HOURS} HOURS"), "yyyy-MM-dd HH:mm:ss")
    return hits.select(F.lit(entity_type).alias("entity_type"), F.col(key).alias("entity_id"),
                       F.col("rule").alias("action"), ts.alias("timestamp"), F.lit(status).alias("status"))


AUDIT_SCHEMA = "entity_type string, entity_id string, action string, timestamp string, status string"


def append_audit(records: DataFrame, path: str, run: str) -> None:
    """Append audit ``records`` to the table at ``path``, a partition for each day and run. A
    run of one name replaces its own partitions, so a repeated run adds nothing."""
    day = F.coalesce(F.substring("timestamp", 1, 10), F.lit("unknown"))
    (records.withColumn("day", day).withColumn("run", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day", "run").parquet(path))


def read_audit(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The audit rows, of one ``day`` only if asked for (its partition alone is read)."""
    rows = spark.read.schema(AUDIT_SCHEMA + ", day string, run string").parquet(path)
    return (rows if day is None else rows.where(F.col("day") == day)).drop("day", "run")


def cooldown(requests: DataFrame, entity: str = "entity_id", action: str = "action",
             ts: str = "ts", hours: int = COOLDOWN_HOURS) -> DataFrame:
    """Greedy cooldown: a request passes if it is at least ``hours`` after the
    last *passed* request of the same (entity, action); the first passes. Of
    requests at the same time one passes. A request without a time never passes
    and holds nothing back; a null entity or action is a key like any other.

    The passed requests form a chain: first request -> ``next`` -> ``next`` ...,
    where ``next(i)`` is the earliest request at least ``hours`` after ``i``. Time
    is cut into buckets of ``hours``, so ``next`` lies in the following bucket or
    is the first request of a later one: a window per (key, bucket) and a window
    over a key's buckets find it, and no task holds all requests of a key. The
    chain is then marked by pointer doubling, joins on (key, time); rounds =
    log2(longest chain).
    """
    spark = requests.sparkSession
    span = hours * 3600 * 1_000_000
    path = scratch_dir(spark, f"cooldown/{uuid.uuid4().hex}")
    r = requests.select(F.struct(F.col(entity).cast("string").alias("e"), F.col(action).cast("string").alias("a")).alias("k"),
                        F.col(ts).alias("t"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
                        F.monotonically_increasing_id().alias("row"))
    r.write.parquet(f"{path}/requests")  # row numbers stay what they are
    r = spark.read.parquet(f"{path}/requests")
    at = r.where(F.col("us").isNotNull()).groupBy("k", "us").agg(F.min("row").alias("row"))
    at = at.withColumn("b", F.floor(F.col("us") / span))

    # A request at x asks its following bucket for the first time from x + span on.
    asks = at.select("k", (F.col("b") + 1).alias("b"), (F.col("us") + span).alias("x"), F.col("us").alias("asker"),
                     F.lit(None).cast("long").alias("found"))
    line = asks.unionByName(at.select("k", "b", F.col("us").alias("x"), F.lit(None).cast("long").alias("asker"),
                                      F.col("us").alias("found")))
    falling = Window.partitionBy("k", "b").orderBy(F.desc("x"), F.col("asker").isNotNull())
    inside = line.withColumn("inside", F.min("found").over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    over_buckets = Window.partitionBy("k").orderBy("b")
    buckets = at.groupBy("k", "b").agg(F.min("us").alias("f0")).select(
        "k", "b", (F.lag("b").over(over_buckets).isNull()).alias("first_bucket"), "f0",
        F.lead("b").over(over_buckets).alias("b1"), F.lead("f0").over(over_buckets).alias("f1"),
        F.lead("f0", 2).over(over_buckets).alias("f2"))
    later = F.when(F.col("b1") >= F.col("b") + 2, F.col("f1")).otherwise(F.col("f2"))
    nxt = (inside.where(F.col("asker").isNotNull()).select("k", (F.col("b") - 1).alias("b"), F.col("asker").alias("us"), "inside")
           .join(buckets, ["k", "b"])
           .select("k", "us", F.coalesce("inside", later).alias("j"),
                   (F.col("first_bucket") & (F.col("us") == F.col("f0"))).alias("root")))
    nxt.write.parquet(f"{path}/next")
    nxt = spark.read.parquet(f"{path}/next")

    jump, chain, step = nxt.where(F.col("j").isNotNull()).select("k", "us", "j"), nxt.where("root").select("k", "us"), 0
    while not jump.isEmpty():
        reached = chain.join(jump, ["k", "us"]).select("k", F.col("j").alias("us"))
        chain.unionByName(reached).write.parquet(f"{path}/chain-{step}")  # paths from a root do not meet twice
        onward = jump.select("k", F.col("us").alias("j"), F.col("j").alias("jj"))
        jump.join(onward, ["k", "j"]).select("k", "us", F.col("jj").alias("j")).write.parquet(f"{path}/jump-{step}")
        chain, jump = spark.read.parquet(f"{path}/chain-{step}"), spark.read.parquet(f"{path}/jump-{step}")
        step += 1
    passed = chain.join(at, ["k", "us"]).select("row", F.lit(True).alias("allowed"))
    return r.join(passed, "row", "left").select(
        F.col("k.e").alias(entity), F.col("k.a").alias(action), F.col("t").alias(ts),
        F.coalesce("allowed", F.lit(False)).alias("allowed"))
