"""Column functions: day rules, weekday bases, text, masks, median."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tradewind.functions import dates as D
from tradewind.functions import text as T
from tradewind.functions.money import money_avg, money_sum
from tradewind.functions.stats import exact_median, exact_medians


def one(spark, expr_df):
    return expr_df.collect()[0]


def test_delay_three_ways(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2, 18))],
                               "a timestamp_ntz, b timestamp_ntz")
    r = df.select(D.floor_days("a", "b").alias("f"), D.trunc_days("a", "b").alias("t"),
                  D.frac_days("a", "b").alias("x")).first()
    assert (r.f, r.t, r.x) == (-2, -1, -1.25)


def test_delay_under_a_day_is_not_late(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 2))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(D.floor_days("a", "b")).first()[0] == 0


def test_weekday_bases(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7),)], "t timestamp_ntz")  # a Sunday
    r = df.select(D.weekday_mon0("t").alias("train"), D.weekday_sun0("t").alias("serve")).first()
    assert (r.train, r.serve) == (6, 0)


def test_month_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 3, 9, 10, 1),)], "t timestamp_ntz")
    r = df.select(D.month_label("t"), D.month_label_text("t")).first()
    assert r[0] == r[1] == "2018-03"


def test_title_case_matches_python(spark):
    words = ["bed_bath_table", "men's t-shirt", "cama_mesa_banho", "1st_choice", "", "ABC def"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = [r[0] for r in df.select(T.category_label("s")).collect()]
    assert got == [w.replace("_", " ").title() for w in words]


def test_mask_email_whole_text(spark):
    df = spark.createDataFrame([("write jane.doe@example.com or bob@mail.org now",)], "s string")
    assert df.select(T.mask_email("s")).first()[0] == "write j***@example.com or b***@mail.org now"


def test_mask_name(spark):
    df = spark.createDataFrame([("Nguyen Van An",)], "s string")
    assert df.select(T.mask_name("s")).first()[0] == "N*** V*** A***"


def test_entity_extract(spark):
    rows = [("Khách `ab-1_x` churn",), ("Seller 9f late",), ("no id here",)]
    df = spark.createDataFrame(rows, "m string")
    got = [tuple(r) for r in df.select(T.extract_entity("m", T.CUSTOMER_WORD),
                                       T.extract_entity("m", T.SELLER_WORD)).collect()]
    assert got == [("ab-1_x", None), (None, "9f"), (None, None)]


def test_median_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert exact_median(df, "x") == 2.5
    assert df.select(F.percentile_approx("x", 0.5)).first()[0] == 2.0  # why we do not use it


def test_median_matches_spark_exact_on_many_rows(spark):
    df = spark.range(0, 20001).select(((F.col("id") * 7919) % 10007 / 3.0).alias("x"))
    want = df.select(F.median("x")).first()[0]
    assert exact_median(df, "x", accuracy=100) == want  # coarse sketch still exact
    assert exact_medians(df, ["x"])["x"] == want


def test_money_sum_is_order_free(spark):
    vals = [(0.1,), (0.2,), (0.3,)] * 1000
    a = spark.createDataFrame(vals, "v double").repartition(7)
    b = spark.createDataFrame(list(reversed(vals)), "v double").repartition(3)
    assert a.select(money_sum("v")).first()[0] == b.select(money_sum("v")).first()[0] == 600.0
    assert a.select(money_avg("v")).first()[0] == 0.2
