"""The cooldown stream: equal to the batch form, expiry, late requests, retries."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from tradewind.operators import actions as AC
from tradewind.streaming import cooldown as CS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "entity_id string, action string, ts timestamp_ntz"


class Stream:
    def __init__(self, spark, base):
        self.spark, self.base = spark, str(base)

    def take(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{self.base}/in")
        self.run()

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.base}/in")
        q = CS.start_cooldown(stream, f"{self.base}/out", f"{self.base}/state", f"{self.base}/ckpt")
        q.awaitTermination()
        assert q.exception() is None

    def results(self):
        return sorted(((r.entity_id, r.action, r.ts, r.allowed, r.late) for r in CS.read_results(self.spark, f"{self.base}/out").collect()), key=str)

    def passed(self, entity):
        return [(ts - T0).total_seconds() / 3600 for e, _, ts, ok, _ in self.results() if ok and e == entity]

    def state(self):
        return CS.read_state(self.spark, f"{self.base}/state").count()


def at(h):
    return T0 + dt.timedelta(hours=h)


def test_in_order_equals_batch(spark, tmp_path):
    rng, rows = random.Random(3), []
    for k in range(150):  # one hot key, null keys, equal times, requests without a time
        key = rng.choice(["hot"] * 5 + ["a", None]), rng.choice(["x", "x", None])
        rows.append((*key, None if k % 40 == 0 else at(rng.randrange(400) / 2)))
    rows.sort(key=lambda r: (r[2] is not None, r[2]))
    s = Stream(spark, tmp_path)
    for k in range(0, 150, 50):
        s.take(rows[k:k + 50])
    batch = AC.cooldown(spark.createDataFrame(rows, SCHEMA))
    got = CS.read_results(spark, f"{tmp_path}/out").drop("late")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_late_requests(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.take([("e", "x", at(50)), ("e", "x", at(105))])
    # 81 h is free on both sides; 85 h is 20 h before a passed one; 30 h and 80 h are older than the mark less the lateness
    s.take([("e", "x", at(h)) for h in (85, 81, 30, 80, 130)])
    assert s.passed("e") == [50, 81, 105, 130]
    assert {(ts - T0).total_seconds() / 3600 for _, _, ts, _, late in s.results() if late} == {30, 80}


def test_state_expires(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.take([(f"e{k}", "x", at(k % 3)) for k in range(30)])
    assert s.state() == 30
    s.take([("other", "x", at(40))])
    assert s.state() == 31  # still within the cooldown and the lateness
    s.take([("other", "x", at(500))])
    assert s.state() == 1
    s.take([("e1", "x", at(501))])
    assert s.state() == 2 and s.passed("e1") == [1, 501]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.take([("e", "x", at(0)), ("f", "x", at(1))])
    s.take([("e", "x", at(10)), ("e", "x", at(30))])
    before = s.results()
    for f in ("1", ".1.crc"):  # the last commit is lost: the batch runs again
        os.unlink(f"{tmp_path}/ckpt/commits/{f}")
    s.run()
    assert s.results() == before and s.passed("e") == [0, 30]


def test_no_worker_holds_a_keys_requests(spark, tmp_path):
    """A third of the rows is one key's; no task of the plan reads them all."""
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("entity_id"), F.lit("x").alias("action"),
                                 F.timestamp_micros(F.col("id") * 3_600_000_000).cast("timestamp_ntz").alias("ts"))
    rows.write.parquet(f"{tmp_path}/rows")
    out, _ = CS.decide(spark.read.parquet(f"{tmp_path}/rows"), spark.createDataFrame([], CS.STATE_SCHEMA))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    assert out.where("entity_id = 'hot' AND allowed").count() == n // 24
