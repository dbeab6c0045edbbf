"""Hand-made boundary cases (FIXTURES.md section 2)."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import make_biz
from tradewind.operators import actions as AC
from tradewind.operators import alerts as AL
from tradewind.operators import dashboards as DB
from tradewind.operators import features as FE
from tradewind.operators import rules as RU
from tradewind.operators import whatif as WI
from tradewind.sources import ingest as IG


def test_bad_time_text_is_null_and_kept(spark):
    df = spark.createDataFrame([("o1", "garbage"), ("o2", ""), ("o3", "2024-01-02 10:00:00")],
                               "order_id string, order_purchase_timestamp string")
    out = IG.coerce(df, IG.SCHEMAS["orders"]).orderBy("order_id").collect()
    assert [r.order_purchase_timestamp for r in out] == [None, None, dt.datetime(2024, 1, 2, 10)]


def test_rows_that_differ_in_any_column_stay(spark, tmp_path):
    text = ('review_id,order_id,review_score,review_comment_message\n'
            'r1,o1,5,"good\nstuff"\nr2,o1,5,fine\nr1,o1,5,"good\nstuff"\n')
    (tmp_path / "olist_order_reviews_dataset.csv").write_text(text)
    tables, _ = IG.ingest(spark, str(tmp_path))
    got = {(r.review_id, r.review_score, r.review_comment_message) for r in tables["order_reviews"].collect()}
    assert got == {("r1", 5, "good\nstuff"), ("r2", 5, "fine")} and tables["order_reviews"].count() == 2
    report = {r.table: (r.status, r.rows) for r in IG.load(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert report["order_reviews"] == ("loaded", 2) and report["geolocation"] == ("missing", None)


def test_duplicate_rows_with_null_and_nan(spark):
    rows = [("a", None, float("nan")), ("a", None, float("nan")), ("a", None, None)]
    df = spark.createDataFrame(rows, "k string, x string, y double")
    assert df.dropDuplicates().count() == 2  # NaN = NaN, null = null, NaN != null


def _risk_biz(spark, review, delivered="2024-01-31 00:00:00", status="delivered"):
    orders = [{"order_id": "o1", "status": status, "delivered": delivered, "estimated": "2024-01-30"}]
    reviews = [("o1", review)] if review is not None else []
    return make_biz(spark, orders=orders, items=[("o1", 1, "p1", "s1", 10.0, 1.0, False)],
                    payments=[("o1", 1, "boleto", 10.0)], reviews=reviews,
                    products=[("p1", "toys", 500.0)])


@pytest.mark.parametrize("review,label", [(2, 1), (3, 0), (None, 0)])
def test_risk_label(spark, review, label):
    r = FE.risk_features(_risk_biz(spark, review)).first()
    assert r.is_risk == label


def test_risk_label_not_delivered(spark):
    b = _risk_biz(spark, 1, delivered=None)
    assert FE.risk_features(b).first().is_risk == 0


def _churn_biz(spark, last_purchase_days):
    base = dt.datetime(2024, 1, 1)
    orders = [{"order_id": "o1", "customer_id": "c1", "purchase": str(base), "delivered": "2024-01-05",
               "estimated": "2024-01-06"},
              {"order_id": "o2", "customer_id": "c2", "purchase": str(base + dt.timedelta(days=last_purchase_days)),
               "delivered": "2024-09-01", "estimated": "2024-09-02"}]
    items = [("o1", 1, "p", "s", 10.0, 1.0, False), ("o2", 1, "p", "s", 10.0, 1.0, False)]
    pays = [("o1", 1, "boleto", 10.0), ("o2", 1, "boleto", 10.0)]
    return make_biz(spark, orders=orders, items=items, payments=pays, products=[("p", "x", 1.0)])


@pytest.mark.parametrize("days,label", [(180, 0), (181, 1)])
def test_churn_label_edge(spark, days, label):
    r = FE.churn_features(_churn_biz(spark, days)).where("customer_id = 'c1'").first()
    assert (r.recency_days, r.is_churn) == (days, label)


def test_median_fill(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    from tradewind.functions.stats import fill_with_median
    assert sorted(r.x for r in fill_with_median(df, ["x"]).collect()) == [1.0, 2.0, 2.5, 3.0, 10.0]


def _fanout_biz(spark):
    orders = [{"order_id": "o1", "customer_id": "c1", "delivered": "2024-01-05", "estimated": "2024-01-06"}]
    items = [("o1", 1, "p", "s", 50.0, 5.0, False), ("o1", 2, "p", "s", 50.0, 5.0, False)]
    pays = [("o1", 1, "credit_card", 60.0), ("o1", 2, "voucher", 40.0)]
    return make_biz(spark, orders=orders, items=items, payments=pays, reviews=[("o1", 4)],
                    products=[("p", "x", 1.0)])


def test_fanout_and_dedup(spark):
    b = _fanout_biz(spark)
    assert FE.churn_features(b).first().monetary == 200.0
    assert FE.churn_features(b, dedup_fanout=True).first().monetary == 100.0


def _seller_biz(spark, n_orders, canceled=0):
    orders, items = [], []
    for i in range(n_orders):
        st = "canceled" if i < canceled else "delivered"
        orders.append({"order_id": f"o{i}", "status": st, "delivered": "2024-01-05"})
        items.append((f"o{i}", 1, "p", "s1", 10.0, 1.0, False))
    return make_biz(spark, orders=orders, items=items, products=[("p", "x", 1.0)],
                    sellers=[(1, "s1", "S")])


@pytest.mark.parametrize("n,kept", [(5, 0), (6, 1)])
def test_having_more_than_five(spark, n, kept):
    assert FE.seller_aggregate(_seller_biz(spark, n)).count() == kept


def test_cancellation_rate(spark):
    r = FE.seller_aggregate(_seller_biz(spark, 4, canceled=1), for_serving=True).first()
    assert r.cancellation_rate == 0.25


def test_trimmed_join_and_title(spark):
    b = make_biz(spark, items=[("o1", 1, "p", "s", 1.0, 0.1, False)], products=[("p", " bed_bath_table ", 1.0)],
                 translation=[("bed_bath_table", "bed_bath_table")])
    top = DB.top_categories(DB.category_sales(b.items, b.products, b.translation)).first()
    assert (top.category, top.total_sold) == ("Bed Bath Table", 1)


def test_mom(spark):
    m = spark.createDataFrame([("2024-01", 100.0, 10, 5), ("2024-02", 150.0, 12, 6)],
                              "month string, revenue double, orders long, customers long")
    r = DB.mom_delta(m).first()
    assert (r.revenue_delta, r.orders_delta) == (50.0, 20.0)
    assert DB.mom_delta(m.limit(1)).first().revenue_delta == 0.0


def test_null_month_sorts_first(spark):
    m = spark.createDataFrame([("2024-01", 100.0, 1, 1), (None, 7.0, 1, 1)],
                              "month string, revenue double, orders long, customers long")
    r = DB.mom_delta(m).first()
    assert r.month is None and r.prev_month == "2024-01"


def test_bands(spark):
    df = spark.createDataFrame([(39.99,), (40.0,), (69.99,), (70.0,)], "s double")
    assert [r[0] for r in df.select(RU.score_band(F.col("s"))).collect()] == ["low", "medium", "medium", "high"]


def _cust(spark, rows):
    schema = ("customer_id string, churn_prob double, monetary double, frequency long, avg_review_score double, "
              "days_since_last long, days_since_delivery long, fav_category string")
    return RU.churn_rules(spark.createDataFrame(rows, schema))


def test_customer_rules_1_to_3(spark):
    rows = [("a", 70.01, 2000.01, 2, 3.0, 10, 10, None), ("b", 70.01, 2000.0, 2, 3.0, 10, 10, None),
            ("c", 70.0, 10.0, 2, 3.0, 10, 10, None), ("d", 50.0, 10.0, 2, 3.0, 10, 10, None),
            ("e", 49.99, 10.0, 2, 3.0, 10, 10, None)]
    got = {(r.customer_id, r.rule) for r in _cust(spark, rows).collect()}
    assert got == {("a", "rule1_vip"), ("b", "rule2_comeback"), ("c", "rule3_survey"), ("d", "rule3_survey")}


def test_customer_rules_4_to_7(spark):
    rows = [("f", 10.0, 10.0, 1, 3.0, 91, 10, None), ("g", 10.0, 10.0, 2, 1.0, 10, 10, None),
            ("h", 10.0, 10.0, 2, 3.0, 61, 10, "toys"), ("i", 10.0, 10.0, 2, 0.0, 10, 3, None)]
    got = {(r.customer_id, r.rule) for r in _cust(spark, rows).collect()}
    assert got == {("f", "rule4_missyou"), ("g", "rule5_refund"), ("h", "rule6_suggest"),
                   ("i", "rule7_review")}


def _sellers(spark, rows):
    schema = ("seller_id string, cluster int, cancellation_rate double, price_increase_pct double, "
              "return_rate double, rating_drop_weeks int, days_on_platform long, total_orders long")
    return {(r.seller_id, r.rule) for r in RU.seller_rules(spark.createDataFrame(rows, schema)).collect()}


def test_seller_rule_thresholds(spark):
    rows = [("a", 1, 0.15, 30.0, 0.10, 2, 100, 5), ("b", 1, 0.16, 31.0, 0.11, 3, 100, 5)]
    assert _sellers(spark, rows) == {("b", "rule1_toxic"), ("b", "rule2_price"), ("b", "rule3_return"),
                                     ("b", "rule4_rating")}


def test_star_veto_and_newbie(spark):
    rows = [("s", 3, 0.16, 0.0, 0.0, 0, 100, 5), ("t", 0, 0.0, 0.0, 0.0, 0, 100, 5),
            ("n", 1, None, None, 0.0, 0, 29, 0)]
    assert _sellers(spark, rows) == {("s", "rule1_toxic"), ("s", "rule5_star_withheld"), ("t", "rule5_star"),
                                     ("n", "rule6_newbie")}


def test_bulky(spark):
    p = spark.createDataFrame([("a", "x", 14990.0), ("b", "x", 15000.0)], "product_id string, "
                              "product_category_name string, product_weight_g double")
    got = {r.product_id: r.can_split for r in RU.bulky_flags(p).collect()}
    assert got == {"a": True, "b": False}


def test_weight_grid(spark):
    df = spark.createDataFrame([(1.5,), (0.55,), (20.0,)], "w double")
    got = [r[0] for r in df.select(WI.weight_grid(F.col("w"))).collect()]
    assert got[0] == pytest.approx([0.1, 0.6, 1.1]) and got[1] == pytest.approx([0.1, 0.6]) and got[2] == [20.0]


ALERT_CASES = [
    json.dumps({"message": "Seller `9f` late", "type": "critical"}),  # kept
    "oops",
    json.dumps({"message": None}),
    "[1,2]",
    json.dumps({"type": "warning"}),  # kept, no message
    "42",
    "{}",  # kept
    '"str"',
    "[]",
    "null",
    json.dumps({"message": 7}),
]


def _raw(spark, texts):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1), t) for i, t in enumerate(texts)],
                                 "seq long, event_time timestamp_ntz, raw string")


def test_alert_parse_skip_rules(spark):
    kept = [r.seq for r in AL.parse_alerts(_raw(spark, ALERT_CASES)).orderBy("seq").collect()]
    assert kept == [0, 4, 6]


def test_alert_rules_equal_a_plain_reader(spark):
    """Arrays, objects and repeated keys, against Python's own JSON reader."""
    texts = ['{"message": ["[CHURN]", 5]}', '{"message": ["a [CHURN]"]}', '{"message": {"Seller": 1}}', '{"message": {"x": "Seller"}}',
             '{"message": "Seller a", "message": "none"}', '{"message": 1, "message": "Kh\u00e1ch `c1`"}',
             '{"message": "x", "message": null}', '{"message": true}', '{"message": ["Seller", "Kh\u00e1ch"], "order_id": 7}',
             '{"order_id": "o1", "message": null}', '{"order_id": "o2", "order_id": "o3"}', '{"message": ""} ', "{'message': 'x'}", '{"a": ']
    want, orders = {}, {}
    for i, t in enumerate(texts):
        try:
            alert = json.loads(t)
            if "order_id" in alert:
                orders[i] = str(alert["order_id"])
            msg = alert.get("message", "")
            want[i] = "churn" if "[CHURN]" in msg or "Khách" in msg else "seller" if "Seller" in msg else "delivery"
        except Exception:
            continue
    raw = _raw(spark, texts)
    assert {r.seq: r.route for r in AL.with_route(AL.parse_alerts(raw)).collect()} == want
    assert {r.seq: r.order_id for r in AL.feed_order_ids(raw).collect()} == orders


def test_alert_route(spark):
    msgs = ["[CHURN] x", "Khách `ab-1_x` đi", "Seller 9f", "[CEO ACTION] Đơn `o1` / Seller `s1`", "other"]
    raw = _raw(spark, [json.dumps({"message": m}) for m in msgs])
    r = AL.with_entity(AL.with_route(AL.parse_alerts(raw))).orderBy("seq").collect()
    assert [x.route for x in r] == ["churn", "churn", "seller", "seller", "delivery"]
    assert [x.entity_id for x in r] == [None, "ab-1_x", "9f", "s1", None]


def test_newest_ten_per_class(spark):
    raw = _raw(spark, [json.dumps({"message": "Seller x"})] * 12)
    routed = AL.with_route(AL.parse_alerts(raw))
    assert AL.route_counts(routed).first().n == 12
    top = AL.top_per_route(routed)
    assert sorted(r.seq for r in top.collect()) == list(range(2, 12))


def test_feed_trim(spark, tmp_path):
    from tradewind.sources.sinks import append_and_trim
    raw = _raw(spark, ["{}"] * 501)
    out = append_and_trim(spark, str(tmp_path / "store"), raw.where("seq < 300"), raw.where("seq >= 300"), 500)
    seqs = [r.seq for r in out.collect()]
    assert len(seqs) == 500 and 0 not in seqs


def test_focus_list_order_and_fill(spark):
    a = spark.createDataFrame([("a", -3), ("b", -2), ("a", -1)], "id string, pos long")
    w = spark.createDataFrame([(x, i) for i, x in enumerate("bcdef", 1)], "id string, pos long")
    got = [r.focus_id for r in AL.focus_list(a, w, "fallback").orderBy("position").collect()]
    assert got == ["a", "b", "c", "d", "e"]


def test_focus_list_empty(spark):
    e = spark.createDataFrame([], "id string, pos long")
    assert [r.focus_id for r in AL.focus_list(e, e, AL.FALLBACK_ORDER_ID).collect()] == [AL.FALLBACK_ORDER_ID]


def test_severity(spark):
    df = spark.createDataFrame([("lock_seller",), ("change_hub",), ("open_ticket",)], "a string")
    assert [r[0] for r in df.select(AC.severity(F.col("a"))).collect()] == ["critical", "critical", "warning"]


def _requests(spark, hours, key="e1"):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(key, "lock", t0 + dt.timedelta(hours=h)) for h in hours],
                                 "entity_id string, action string, ts timestamp_ntz")


def _passed(df):
    t0 = dt.datetime(2024, 1, 1)
    return sorted(int((r.ts - t0).total_seconds() // 3600) for r in df.where("allowed").collect())


def test_cooldown(spark):
    assert _passed(AC.cooldown(_requests(spark, [0, 10, 24, 30, 48]))) == [0, 24, 48]


def test_cooldown_against_a_plain_loop(spark):
    """Many keys, one hot; equal times, null times and null keys."""
    import random
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice(["x", None]),
             None if rng.random() < 0.05 else base + dt.timedelta(minutes=rng.choice([1440 * rng.randrange(40), rng.randrange(60000)])))
            for _ in range(3000)]
    want, last = {}, {}
    for e, a, t in sorted((r for r in rows if r[2]), key=lambda r: r[2]):
        if (e, a) not in last or t - last[e, a] >= dt.timedelta(hours=24):
            last[e, a] = t
            want[e, a, t] = 1
    got = AC.cooldown(spark.createDataFrame(rows, "entity_id string, action string, ts timestamp_ntz")).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.entity_id), str(r.action), r.ts) for r in got if r.allowed) == sorted((str(e), str(a), t) for e, a, t in want)


def test_cooldown_windows_hold_no_whole_key(spark):
    plan = AC.cooldown(_requests(spark, [0, 10, 24]))
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()  # nothing but joins after the written steps


def test_action_payload_is_json_for_any_id(spark):
    import json
    df = spark.createDataFrame([('o"\\1', "s\n2", "lock_seller", 905, dt.datetime(2024, 1, 1))],
                               "order_id string, seller_id string, action string, risk_score_tenths long, decided_at timestamp_ntz")
    got = json.loads(AC.action_events(df).first().payload)
    assert got["order_id"] == 'o"\\1' and "s\n2" in got["message"] and got["risk_score"] == 90.5
