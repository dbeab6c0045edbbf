"""A monitor whose cost follows the changes.

The source is a change log: a row for each insert, change or closing of an
entity, with a number that rises with each change of that entity. Rows are
scored as they arrive, so only what changed is scored. A table beside the
snapshots holds the last flag of each entity, in buckets by the entity's hash; a
change gives the signed difference between its flag and the last one, and the
counts move by the sum of the differences. A micro-batch is reduced to the last
change of each entity and reads and rewrites only the buckets in which something
changed; all of it is joins and sums of columns, without a call for each entity.

* The last change of an entity in a micro-batch counts, and none whose number is
  not above the one applied last, so changes may come twice or late.
* A closing takes the flag back. Its number is remembered, so that a change that
  comes late does not open it again: for ``CLOSED_FOR`` under a processing-time
  trigger, for good in a run that takes what is there and ends (``available_now``).
* Buckets and counts are written as generations numbered by micro-batch: a batch
  that is run again finds the former buckets, and with its own snapshot in place it
  changes nothing. The number of buckets is fixed when the first one is written.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.streaming.alert_stream import _fs, complete_generations, delete_generation, generation_path, latest_generation

CLOSED_FOR = 7 * 24 * 3_600_000  # milliseconds
STATE = "kind string, entity_id string, seq long, code int, closed_ms long, delta int, open_delta int, scored long, us long"
TOTALS = "kind string, flagged long, open long, scored long, us long"
TRIGGER = "10 seconds"
DEFAULT_BUCKETS = 64
#: What an entity's last change left behind.
PLAIN, FLAGGED, CLOSED = 0, 1, 2


def _names(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders ``prefix``n in ``path``."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(n[len(prefix):]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(prefix))


def bucket_versions(spark: SparkSession, state_dir: str, below: int) -> dict[int, int]:
    """The newest complete generation below ``below`` of each bucket. Older ones, which no
    batch can ask for again, are deleted."""
    newest: dict[int, int] = {}
    for g in reversed([g for g in complete_generations(spark, state_dir) if g < below]):
        held = _names(spark, generation_path(state_dir, g), "bucket=")
        for k in held:
            if newest.setdefault(k, g) != g:
                fs, p = _fs(spark, f"{generation_path(state_dir, g)}/bucket={k}")
                fs.delete(p, True)
        if all(newest[k] != g for k in held):
            delete_generation(spark, state_dir, g)
    return newest


def _last_changes(rows: DataFrame, buckets: int) -> DataFrame:
    """The last change of each entity, how many of its rows were scored, its newest time."""
    code = F.when(F.col("closing"), CLOSED).when(F.col("flag"), FLAGGED).otherwise(PLAIN)
    key = ("kind", "entity_id")
    return rows.groupBy(F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket"), *key).agg(
        F.max("seq").alias("new_seq"), F.max_by(code, F.col("seq")).alias("new_code"),
        F.count_if(~F.col("closing")).alias("scored"), F.max("us").alias("us"))


def _moved(changes: DataFrame, before: DataFrame | None, buckets: int, now_ms: int) -> DataFrame:
    """The rows of the touched buckets after the changes, with what each entity adds to the counts."""
    none = F.lit(None)
    rows = changes.withColumns({"old_seq": none.cast("long"), "old_code": none.cast("int"), "old_closed": none.cast("long")})
    if before is not None:
        rows = rows.unionByName(before.select(
            F.pmod(F.xxhash64("kind", "entity_id"), F.lit(buckets)).cast("int").alias("bucket"), "kind", "entity_id",
            F.col("seq").alias("old_seq"), F.col("code").alias("old_code"), F.col("closed_ms").alias("old_closed")), allowMissingColumns=True)
    # Dealt by bucket, so that the sums need no second exchange and a bucket is one file.
    one = rows.repartition(buckets, "bucket").groupBy("bucket", "kind", "entity_id").agg(
        *[F.max(c).alias(c) for c in ("old_seq", "old_code", "old_closed", "new_seq", "new_code", "us")], F.sum("scored").alias("scored"))
    applied = F.coalesce((F.col("old_seq").isNull() & F.col("new_seq").isNotNull()) | (F.col("new_seq") > F.col("old_seq")), F.lit(False))
    is_in = lambda c, *codes: F.coalesce(F.col(c).isin(*codes), F.lit(False)).cast("int")
    step = lambda *codes: F.when(applied, is_in("new_code", *codes) - is_in("old_code", *codes)).otherwise(0)
    return one.select(
        "bucket", "kind", "entity_id", F.when(applied, F.col("new_seq")).otherwise(F.col("old_seq")).alias("seq"),
        F.when(applied, F.col("new_code")).otherwise(F.col("old_code")).alias("code"),
        F.when(applied, F.when(F.col("new_code") == CLOSED, F.lit(now_ms))).otherwise(F.col("old_closed")).alias("closed_ms"),
        step(FLAGGED).alias("delta"), step(PLAIN, FLAGGED).alias("open_delta"), F.coalesce("scored", F.lit(0)).alias("scored"), "us")


def start_change_monitor(changes: DataFrame, flag: Callable[[DataFrame], DataFrame], snapshot_dir: str, checkpoint: str,
                         available_now: bool = True, state_partitions: int | None = None):
    """``changes``: streaming (kind, entity_id, seq, closing, event_time, ...). ``flag(df)``
    adds a boolean ``flag`` to the rows of ``df``; it sees each changed row once.
    ``state_partitions``: the number of buckets, where none is written yet."""
    scored = flag(changes.where("NOT closing")).select("kind", "entity_id", "seq", "closing", "flag", "event_time")
    closings = changes.where("closing").select("kind", "entity_id", "seq", "closing", F.lit(False).alias("flag"), "event_time")
    rows = scored.unionByName(closings).select("kind", "entity_id", "seq", "closing", F.coalesce("flag", F.lit(False)).alias("flag"),
                                               F.unix_micros(F.col("event_time").cast("timestamp")).alias("us"))

    def publish(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        done = complete_generations(session, snapshot_dir)
        if epoch_id in done:
            return
        buckets = (_names(session, f"{snapshot_dir}/state", "buckets=") or [state_partitions or DEFAULT_BUCKETS])[0]
        state_dir, now_ms = f"{snapshot_dir}/state/buckets={buckets}", int(time.time() * 1000)
        versions = bucket_versions(session, state_dir, epoch_id)
        # Written, not persisted: tasks of a persisted plan carry what it was made from, here the models of ``flag``.
        landed, last = f"{snapshot_dir}/state/landed", _last_changes(batch, buckets)
        last.write.mode("overwrite").parquet(landed)
        last = session.read.schema(last.schema).parquet(landed)
        touched = sorted(r["bucket"] for r in last.select("bucket").distinct().collect())
        paths = [f"{generation_path(state_dir, versions[k])}/bucket={k}" for k in touched if k in versions]
        before = session.read.schema(STATE).parquet(*paths) if paths else None
        if before is not None and not available_now:
            before = before.where((F.col("code") != CLOSED) | (F.col("closed_ms") >= now_ms - CLOSED_FOR))
        own = generation_path(state_dir, epoch_id)
        _moved(last, before, buckets, now_ms).write.mode("overwrite").partitionBy("bucket").parquet(own)
        moved = session.read.schema(STATE).parquet(own).groupBy("kind").agg(
            F.sum("delta").alias("flagged"), F.sum("open_delta").alias("open"), F.sum("scored").alias("scored"), F.max("us").alias("us"))
        counted = [g for g in done if g < epoch_id]
        if counted:
            moved = moved.unionByName(session.read.schema(TOTALS).parquet(generation_path(snapshot_dir, counted[-1])))
        totals = moved.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("flagged", "open", "scored")], F.max("us").alias("us"))
        totals.coalesce(1).write.mode("overwrite").parquet(generation_path(snapshot_dir, epoch_id))  # a row for each kind
        for g in counted[:-1]:
            delete_generation(session, snapshot_dir, g)

    w = rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TRIGGER)
    return w.start()


def kpi_text(totals: DataFrame, risk: str, churn: str) -> DataFrame:
    """The published snapshot (one JSON text): the counts of the two kinds and the local
    time of the newest change."""
    count = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("flagged"))), F.lit(0))
    clock = F.date_format(F.max(F.timestamp_micros("us")) + F.expr("INTERVAL 7 HOURS"), "HH:mm:ss")
    one = totals.agg(count(risk).alias("risk_count"), count(churn).alias("churn_count"), clock.alias("scan_time"))
    return one.select(F.to_json(F.struct("risk_count", "churn_count", "scan_time")).alias("value"))


def read_totals(spark: SparkSession, snapshot_dir: str) -> DataFrame:
    """The last counts: a row for each kind of entity."""
    g = latest_generation(spark, snapshot_dir)
    return spark.read.schema(TOTALS).parquet(g) if g else spark.createDataFrame([], TOTALS)
