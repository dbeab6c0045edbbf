"""The change monitor: equal to a full rescan after every batch, retries, late and repeated changes."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tradewind.streaming import change_monitor as CM
from tradewind.streaming import monitor as MO

SCHEMA = "kind string, entity_id string, seq long, closing boolean, event_time timestamp_ntz, score int"
T0 = dt.datetime(2024, 1, 1)


class Watch:
    def __init__(self, spark, base):
        self.spark, self.base, self.log, self.seen = spark, str(base), [], spark.sparkContext.accumulator(0)

    def take(self, rows):
        self.log += rows
        self.spark.createDataFrame([(*r[:4], T0, r[4]) for r in rows], SCHEMA).coalesce(2).write.mode("append").parquet(f"{self.base}/in")
        self.run()

    def run(self):
        own = self.spark.newSession()
        q = CM.start_change_monitor(own.readStream.schema(SCHEMA).parquet(f"{self.base}/in"), lambda df: df.withColumn("flag", F.col("score") > 50),
                                    f"{self.base}/snap", f"{self.base}/ckpt", state_partitions=2)
        q.awaitTermination()
        assert q.exception() is None

    def totals(self):
        return {r.kind: (r.flagged, r.open, r.scored) for r in CM.read_totals(self.spark, f"{self.base}/snap").collect()}

    def rescan(self):
        last, out = {}, {}
        for kind, entity, seq, closing, score in self.log:
            if (kind, entity) not in last or seq > last[kind, entity][0]:
                last[kind, entity] = seq, closing, score
        for kind in {r[0] for r in self.log}:
            rows = [v for (k, _), v in last.items() if k == kind]
            out[kind] = (sum(not c and s > 50 for _, c, s in rows), sum(not c for _, c, _ in rows), sum(r[0] == kind and not r[3] for r in self.log))
        return out


def test_equals_a_rescan(spark, tmp_path):
    w, rng, seq = Watch(spark, tmp_path), random.Random(2), 0
    w.take([("order", f"o{k}", 1, False, k * 9 % 100) for k in range(12)] + [("customer", "c0", 1, False, 90)])
    assert w.totals() == w.rescan()
    for _ in range(3):  # changes, closings, reopenings, several of one entity in a batch, repeated and late ones
        rows = []
        for _ in range(10):
            seq += 1
            closing = rng.random() < 0.3
            rows.append(("order", f"o{rng.randrange(15)}", 1 + seq, closing, None if closing else rng.randrange(100)))
        rows += [rows[0], ("order", "o3", 1, False, 99), ("customer", "c0", 1, False, 0)]
        w.take(rows)
        assert w.totals() == w.rescan()
    before = w.totals()
    for f in ("3", ".3.crc"):  # the last commit is lost: the batch runs again
        os.unlink(f"{tmp_path}/ckpt/commits/{f}")
    w.run()
    assert w.totals() == before
    text = CM.kpi_text(CM.read_totals(spark, f"{tmp_path}/snap"), "order", "customer")
    path = f"{tmp_path}/kpi/gen={0:012d}"
    text.write.text(path)
    assert MO.read_snapshot(spark, f"{tmp_path}/kpi").first() == (before["order"][0], before["customer"][0], "07:00:00")


def test_no_changes_yet(spark, tmp_path):
    assert CM.read_totals(spark, str(tmp_path / "none")).count() == 0
    assert MO.read_snapshot(spark, str(tmp_path / "none")).first() == (0, 0, "")


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    w = Watch(spark, tmp_path)
    w.take([("order", f"o{k}", 1, False, 90) for k in range(20)])
    state = f"{tmp_path}/snap/state/buckets=2"
    assert CM.bucket_versions(spark, state, 1) == {0: 0, 1: 0}
    w.take([("order", "o3", 2, True, None)])
    after = CM.bucket_versions(spark, state, 2)
    assert sorted(after.values()) == [0, 1]  # the other bucket is that of the first batch
    w.take([("order", "o3", 1, False, 99), ("order", "o3", 3, False, 10)])
    assert w.totals() == w.rescan() == {"order": (19, 20, 22)}


def test_a_lost_snapshot_is_counted_again_from_the_former_buckets(spark, tmp_path):
    import shutil
    w = Watch(spark, tmp_path)
    w.take([("order", f"o{k}", 1, False, 90) for k in range(9)])
    w.take([("order", "o3", 2, True, None), ("order", "o4", 2, False, 1)])
    shutil.rmtree(f"{tmp_path}/snap/gen={1:012d}")
    for f in ("1", ".1.crc"):
        os.unlink(f"{tmp_path}/ckpt/commits/{f}")
    w.run()
    assert w.totals() == w.rescan() == {"order": (7, 8, 10)}


def test_what_follows_the_scores_does_not_carry_the_model(spark, tmp_path, monkeypatch):
    """The tasks that update buckets and counts read the written changes; what they read before led back to the scoring."""
    seen, moved = [], CM._moved
    monkeypatch.setattr(CM, "_moved", lambda changes, *a: seen.append(changes._jdf.queryExecution().toRdd().toDebugString()) or moved(changes, *a))
    rows = spark.createDataFrame([("order", "a", 1, False, None), ("order", "b", 1, False, None)],
                                 "kind string, entity_id string, seq long, closing boolean, event_time timestamp_ntz")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    flag = lambda df: df.withColumn("flag", F.concat("entity_id", F.lit("the-model")) == "athe-model")
    query = CM.start_change_monitor(stream, flag, str(tmp_path / "out"), str(tmp_path / "ckpt"), state_partitions=2)
    query.awaitTermination()
    assert seen and all("Shuffled" not in lineage and "MapPartitionsRDD" in lineage for lineage in seen)
    assert [(r["flagged"], r["open"], r["scored"]) for r in CM.read_totals(spark, str(tmp_path / "out")).collect()] == [(1, 2, 2)]
