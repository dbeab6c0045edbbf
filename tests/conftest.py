from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tradewind.session import build_session
    s = build_session("local[4]", app="tradewind-tests", shuffle_partitions=8)
    yield s
    s.stop()


def ts(s: str | None):
    return None if s is None else dt.datetime.fromisoformat(s)


ORDER_COLS = ("o_orderkey bigint, order_id string, customer_id string, order_status string, "
              "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
              "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
              "order_estimated_delivery_date timestamp_ntz")
ITEM_COLS = ("order_id string, order_item_id int, product_id string, seller_id string, price double, "
             "freight_value double, is_returned boolean")
PAY_COLS = "order_id string, payment_sequential int, payment_type string, payment_value double"
REV_COLS = "order_id string, review_score int"
PROD_COLS = "product_id string, product_category_name string, product_weight_g double"
TR_COLS = "product_category_name string, product_category_name_english string"
CUST_COLS = "c_custkey bigint, customer_id string, customer_unique_id string, customer_name string"
SELL_COLS = "s_suppkey bigint, seller_id string, seller_name string"


def make_biz(spark, orders=(), items=(), payments=(), reviews=(), products=(), translation=(),
             customers=(), sellers=()):
    """A Biz from hand-made rows. ``orders`` rows are dicts with the keys
    order_id, customer_id, status, purchase, delivered, estimated."""
    from tradewind.sources.business import Biz
    orows = []
    for i, o in enumerate(orders):
        orows.append((i, o["order_id"], o.get("customer_id", "c1"), o.get("status", "delivered"),
                      ts(o.get("purchase", "2024-01-01")), ts(o.get("purchase", "2024-01-01")),
                      ts(o.get("delivered")), ts(o.get("delivered")), ts(o.get("estimated", "2024-01-30"))))
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    o = df(orows, ORDER_COLS)
    return Biz(orders=o, items=df(items, ITEM_COLS), payments=df(payments, PAY_COLS),
               reviews=df(reviews, REV_COLS), products=df(products, PROD_COLS),
               translation=df(translation, TR_COLS), customers=df(customers, CUST_COLS),
               sellers=df(sellers, SELL_COLS), orders_base=o)
