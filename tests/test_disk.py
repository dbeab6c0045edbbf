"""What the model queries leave on disk: shuffle files go with their query, few rows are dealt."""

from __future__ import annotations

import random
import time

import pytest

from tests.conftest import SMOKE, make_biz
from tradewind.operators import features as FE
from tradewind.operators import ml as ML
from tradewind.session import DROP_SHUFFLES, shuffles_dropped
from tradewind.sources import adapter as A
from tradewind.sources import warehouse


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}


def left_by(spark, run):
    before = shuffle_files(spark)
    kept = run()
    for _ in range(20):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return kept, left


def _biz(spark, n=400):
    rng = random.Random(4)
    orders = [{"order_id": f"o{k}", "status": ("delivered", "shipped", "processing")[k % 3], "delivered": "2024-03-01" if k % 2 else "2024-01-20"} for k in range(n)]
    items = [(f"o{k}", j, None if rng.random() < 0.1 else f"p{rng.randrange(40)}", f"s{rng.randrange(5)}", 1.0, 1.0, False) for k in range(n) for j in rng.sample(range(1, 5), rng.randrange(4))]
    payments = [(f"o{k}", j, rng.choice(["voucher", "boleto"]), float(rng.randrange(400))) for k in range(n) for j in rng.sample(range(1, 4), rng.randrange(3))]
    reviews = [(f"o{k}", 1 + rng.randrange(5)) for k in range(n) for _ in range(rng.randrange(3))]
    return make_biz(spark, orders, items, payments, reviews, [(f"p{k}", "c", None if k == 3 else 10.0 * k) for k in range(30)])


def test_training_rows_leave_no_shuffle_files(spark):
    was = spark.conf.get(DROP_SHUFFLES)
    for make in (ML.risk_training_rows, ML.churn_training_rows):
        rows, left = left_by(spark, lambda make=make: make(_biz(spark)))
        assert not left and rows.count() > 0
    assert spark.conf.get(DROP_SHUFFLES) == was


def test_the_setting_comes_back(spark):
    was = spark.conf.get(DROP_SHUFFLES)
    with pytest.raises(KeyError), shuffles_dropped(spark):
        with shuffles_dropped(spark):
            assert spark.conf.get(DROP_SHUFFLES) == "true"
        assert spark.conf.get(DROP_SHUFFLES) == "true"
        raise KeyError
    assert spark.conf.get(DROP_SHUFFLES) == was


def test_the_load_leaves_no_shuffle_files_and_deals_narrow_rows(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "_names", lambda spark, d: {t: f"tw_disk_{t}" for t in A.VIEWS})
    monkeypatch.setattr(warehouse, "_BUILT", {})
    names, left = left_by(spark, lambda: warehouse.build(spark, SMOKE, 3))
    assert not left
    for table in warehouse.ORDER_GRAIN:
        got, want = spark.table(names[table]), A.VIEWS[table](spark, SMOKE)
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        dealt = A.VIEWS[table](spark, SMOKE, deal=lambda rows, key: rows.repartition(3, A.order_id(key)))._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
        assert len(dealt) > 1 and all("order_id" not in below.split("\n")[1] for below in dealt[1:])


def test_first_row_of_each_open_order(spark):
    b = _biz(spark)
    weight = {r["product_id"]: r["product_weight_g"] for r in b.products.collect()}
    pays = {}
    for r in b.payments.collect():
        pays.setdefault(r["order_id"], []).append((r["payment_sequential"], r["payment_type"], r["payment_value"]))
    want, skipped = {r["order_id"]: None for r in b.orders.where("order_status <> 'delivered'").collect()}, 0
    items = {}
    for r in b.items.collect():
        items.setdefault(r["order_id"], []).append((r["order_item_id"], r["product_id"] or "", r["seller_id"]))
    for k in list(want):
        known = sorted(i for i in items.get(k, []) if i[1] in weight)
        if not known or k not in pays:
            del want[k]
            continue
        skipped += known[0] != min(items[k])
        pay = min(pays[k])
        want[k] = (known[0][2], weight[known[0][1]], pay[1], pay[2])
    got = ML.open_order_features(b)
    assert {r["order_id"]: (r["seller_id"], r["product_weight_g"], r["payment_type"], r["order_value"]) for r in got.collect()} == want
    assert got.count() == len(want) and skipped > 5
    # The first row is chosen below the product join: what is dealt by product is one row an order.
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_weights_before_the_fan_out_give_the_same_rows(spark):
    b = _biz(spark)
    last, first = FE.risk_features(b), FE.risk_features(b, lambda rows: rows)
    assert first.columns == last.columns and last.count() == first.count() > 50
    assert first.exceptAll(last).count() == last.exceptAll(first).count() == 0
