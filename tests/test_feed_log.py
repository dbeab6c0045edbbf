"""The feed as a log of segments: idempotent pushes, skipped segments, refused types."""

from __future__ import annotations

import os
import random

import pytest

from tradewind.sources.feed_log import FeedLog

SCHEMA = "seq bigint, raw string"


def rows(spark, seqs):
    return spark.createDataFrame([(s, f"raw {s}") for s in seqs], SCHEMA)


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def newest(log, n):
    return [r.seq for r in log.newest(n).collect()]


def test_a_push_writes_one_segment_and_copies_nothing(spark, tmp_path):
    log = FeedLog(spark, str(tmp_path / "log"), SCHEMA)
    assert newest(log, 5) == [] and log.last_number() == -1
    spark.range(200_000).selectExpr("id AS seq", "concat('raw ', id) AS raw").write.parquet(str(tmp_path / "big"))
    assert log.adopt(str(tmp_path / "big"), 0)
    assert files(tmp_path / "log") == []  # taken up as it lies
    assert log.push(rows(spark, range(200_000, 200_003)), 1)
    first = files(tmp_path / "log")
    assert log.push(rows(spark, [200_003]), 2)
    assert set(first) < set(files(tmp_path / "log"))
    assert newest(log, 5) == [200_003, 200_002, 200_001, 200_000, 199_999]
    assert newest(log, 2) == [200_003, 200_002] and [s.number for s in log.needed(2)] == [1, 2]


def test_a_repeated_push_changes_nothing(spark, tmp_path):
    log = FeedLog(spark, str(tmp_path), SCHEMA)
    assert log.push(rows(spark, [1, 2, 3]), 1) and not log.push(rows(spark, [7, 8, 9]), 1)
    assert newest(log, 10) == [3, 2, 1]
    log.push(rows(spark, [4]), 2)
    assert log.trim(1) == [1]
    assert not log.push(rows(spark, [5]), 1)  # trimmed away, still done
    assert newest(log, 10) == [4]


def test_newest_equals_a_sort_of_everything(spark, tmp_path):
    rng, log, all_seqs = random.Random(4), FeedLog(spark, str(tmp_path), SCHEMA), []
    for number in range(1, 9):  # overlapping ranges, pushes out of order, an empty one, rows without a number
        seqs = [] if number == 4 else [rng.randrange(100) * 10 + number for _ in range(rng.randrange(1, 6))] + [None] * (number == 3)
        log.push(rows(spark, seqs), number)
        all_seqs += seqs
    for n in (1, 3, 7, 100):
        want = sorted(all_seqs, key=lambda s: (s is None, -(s or 0)))[:n]
        assert newest(log, n) == want
    log.trim(7)
    assert newest(log, 7) == sorted((s for s in all_seqs if s is not None), reverse=True)[:7]
    assert len(log.segments()) <= 7


def test_other_types_are_cast_or_refused(spark, tmp_path):
    log = FeedLog(spark, str(tmp_path), SCHEMA)
    log.push(spark.createDataFrame([(1, "a")], "seq int, raw string"), 1)
    log.push(spark.createDataFrame([(1 << 40, "b")], SCHEMA), 2)
    assert newest(log, 2) == [1 << 40, 1]
    for schema, row in (("seq string, raw string", ("3", "c")), ("seq bigint", (3,)), ("seq double, raw string", (3.0, "c"))):
        with pytest.raises(ValueError, match="column"):
            log.push(spark.createDataFrame([row], schema), 3)
    assert newest(log, 2) == [1 << 40, 1]
