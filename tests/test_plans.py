"""Physical plan shape at scale settings (broadcast joins disabled).

These pin the properties the design relies on at 100 TB: order-grain joins
on the bucketed warehouse tables need no exchange, distinct counts never
Expand the fan-out rows, status filters reach the parquet reader, and
per-group top-k keeps only k rows per task before the shuffle.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from conftest import SMOKE
from tradewind.operators import features as FE
from tradewind.sources.business import from_testdata


@pytest.fixture()
def scale_conf(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the static plan, before runtime changes
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(p: str) -> list[str]:
    return [line.strip() for line in p.splitlines() if "Exchange" in line]


def test_churn_aggregate_one_shuffle_no_expand(scale_conf):
    p = plan(FE._churn_aggregate(from_testdata(scale_conf, SMOKE)))
    assert "Expand" not in p
    ex = exchanges(p)
    assert len(ex) == 1 and "customer_id" in ex[0]  # the order joins are exchange-free
    assert "SortMergeJoin" in p


def test_seller_aggregate_no_expand(scale_conf):
    p = plan(FE.seller_aggregate(from_testdata(scale_conf, SMOKE)))
    assert "Expand" not in p
    assert all("order_id" not in e for e in exchanges(p))


def test_status_filter_pushed_to_parquet(scale_conf):
    p = plan(FE.risk_base(from_testdata(scale_conf, SMOKE)))
    assert "EqualTo(order_status,delivered)" in p


def test_risk_base_product_join_last(scale_conf):
    ex = exchanges(plan(FE.risk_base(from_testdata(scale_conf, SMOKE))))
    assert ex and all("product_id" in e for e in ex)  # only the product join shuffles


@pytest.mark.parametrize("key", ["alert_top10_per_route", "customer_inputs"])
def test_group_top_k_is_partial_before_shuffle(scale_conf, key):
    p = plan(E.queries()[key](scale_conf, SMOKE))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_newest_n_is_take_ordered(scale_conf):
    p = plan(E.queries()["open_orders_latest"](scale_conf, SMOKE))
    assert "TakeOrderedAndProject" in p
