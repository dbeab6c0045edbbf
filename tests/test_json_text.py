"""JSON string escapes equal to Python's."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tradewind.functions.text import title_case
from tradewind.operators.actions import json_text


def test_equals_json_dumps(spark):
    texts = ["plain", "é", "😀", "a\"b\\c/d", "\n\t\r\b\f", "\x00\x01\x1f\x0b", "\x7f", "Đơn `ab` – Khách", "\\u001F", "漢字 ", "", "\\\x1e", "x\\\\u001A"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.j for r in rows.select("k", json_text(F.col("t")).alias("j")).collect()}
    assert [got[k] for k in range(len(texts))] == [json.dumps(t)[1:-1] for t in texts]


def test_title_case_equals_python(spark):
    texts = ["men's t-shirt", "bed_bath table", "o'neil's", "a1b2c", "x-ray/gamma", "", "ÉCLAIR éclair", "l'été"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.j for r in rows.select("k", title_case("t").alias("j")).collect()}
    assert [got[k] for k in range(len(texts))] == [t.title() for t in texts]
