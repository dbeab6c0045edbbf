"""Retries and absent stores of the streaming sinks."""

from __future__ import annotations

import datetime as dt
import os

from tradewind.streaming import alert_stream as AS
from tradewind.streaming import monitor as MO


def _feed(spark, path, first, n):
    rows = [(first + i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=first + i), f"raw{first + i}") for i in range(n)]
    spark.createDataFrame(rows, AS.RAW_SCHEMA).write.mode("append").parquet(path)


def test_bounded_store_survives_a_retried_batch(spark, tmp_path):
    base = str(tmp_path)
    store = lambda: AS.start_bounded_store(
        AS.read_alert_stream(spark, f"{base}/in", files_per_trigger=100), f"{base}/store", f"{base}/ckpt", keep=7).awaitTermination()
    seqs = lambda: sorted(r.seq for r in AS.read_bounded_store(spark, f"{base}/store").collect())
    assert seqs() == []
    for k in range(3):
        _feed(spark, f"{base}/in", 5 * k, 5)
        store()
    assert seqs() == list(range(8, 15))
    for f in ("2", ".2.crc"):  # the last commit is lost: the batch runs again
        os.unlink(f"{base}/ckpt/commits/{f}")
    store()
    assert seqs() == list(range(8, 15))
    _feed(spark, f"{base}/in", 15, 2)
    store()
    assert seqs() == list(range(10, 17))
    assert len(AS.complete_generations(spark, f"{base}/store")) == 2


def test_snapshot_absent_and_rescanned(spark, tmp_path):
    base = str(tmp_path)
    assert MO.read_snapshot(spark, f"{base}/snap").first() == (0, 0, "")
    counts = iter([(5, 2), (3, 1)])
    for k in range(2):
        _feed(spark, f"{base}/in", k, 1)
        MO.start_monitor(AS.read_alert_stream(spark, f"{base}/in", files_per_trigger=100),
                         lambda: spark.createDataFrame([next(counts)], "risk_count long, churn_count long"),
                         f"{base}/snap", f"{base}/ckpt").awaitTermination()
    assert MO.read_snapshot(spark, f"{base}/snap").first() == (3, 1, "07:01:00")
