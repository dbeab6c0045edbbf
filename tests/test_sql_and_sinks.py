"""SQL text over the warehouse; S5/S11: sinks and store reset."""

from __future__ import annotations

from conftest import SMOKE
from pyspark.sql import functions as F
from oracle_check import digest

from tradewind.sources import warehouse
from tradewind.sources.business import from_testdata
from tradewind.sources.sinks import truncate_table, write_table


def test_sql_text_over_warehouse_matches_dataframe(spark):
    warehouse.register_views(spark, SMOKE)
    sql = """
        WITH per_order AS (SELECT order_id, payment_type, sum(CAST(payment_value AS DECIMAL(18,4))) AS paid FROM order_payments GROUP BY ALL)
        SELECT payment_type, year(order_purchase_timestamp) * 100 + month(order_purchase_timestamp) AS ym, CAST(sum(paid) AS DOUBLE) AS paid
        FROM orders JOIN per_order USING (order_id) GROUP BY ALL
    """
    a = spark.sql(sql)
    biz = from_testdata(spark, SMOKE)
    when = F.col("order_purchase_timestamp")
    b = (biz.payments.join(biz.orders, "order_id").groupBy("payment_type", (F.year(when) * 100 + F.month(when)).alias("ym"))
         .agg(F.sum(F.col("payment_value").cast("decimal(18,4)")).cast("double").alias("paid")))
    assert digest(a.columns, [tuple(r) for r in a.collect()])[0] == digest(b.columns, [tuple(r) for r in b.collect()])[0]


def test_overwrite_sink_and_reset(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, raw string")
    path = str(tmp_path / "feed")
    write_table(df, path, "overwrite")
    write_table(df, path, "overwrite")  # full replace is idempotent
    assert spark.read.parquet(path).count() == 2
    write_table(df, path, "append")
    assert spark.read.parquet(path).count() == 4
    truncate_table(spark, path, "seq long, raw string")
    assert spark.read.parquet(path).count() == 0
