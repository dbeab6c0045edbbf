"""Rule inputs, rules, newest ids, encodings and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators import features as FE
from tradewind.operators import inputs as IN
from tradewind.operators import metrics as MT
from tradewind.operators import rules as RU
from tradewind.plans.catalog import register
from tradewind.plans.feature_plans import (FLOOR_DAYS, RISK_BASE_SQL, RISK_FEATURES_CTES,
                                           churn_agg_sql, churn_features_ctes, seller_agg_sql)
from tradewind.plans.oracle_views import int_avg, money_avg, with_views
from tradewind.sources.business import Biz, from_testdata

# ---------------------------------------------------------------- stand-in scores
# Rule keys with a SQL oracle use scores that SQL can repeat; the model keys
# (score_*) use fitted models.


def order_score(b: Biz) -> DataFrame:
    return b.orders_nodates.select(
        "order_id", "o_orderkey",
        ((F.col("o_orderkey") * 37) % 1000).cast("double") / F.lit(10.0)).toDF(
        "order_id", "o_orderkey", "risk_score")


def customer_score(b: Biz) -> DataFrame:
    return b.customers.select(
        "customer_id", (((F.col("c_custkey") * 53) % 1000).cast("double") / F.lit(10.0))
        .alias("churn_prob"))


def seller_cluster(b: Biz) -> DataFrame:
    return b.sellers.select("seller_id", (F.col("s_suppkey") % 4).cast("int").alias("cluster"))


ORDER_SCORE_SQL = "CAST(o_orderkey * 37 % 1000 AS DOUBLE) / CAST(10.0 AS DOUBLE)"
CUSTOMER_SCORE_SQL = "CAST(c_custkey * 53 % 1000 AS DOUBLE) / CAST(10.0 AS DOUBLE)"

ASOF_SQL = "(SELECT max(order_purchase_timestamp) FROM b_orders_base)"

# ---------------------------------------------------------------- SQL CTEs

CUSTOMER_INPUTS_CTES = f""", fc AS (
  SELECT o.customer_id, trim(p.product_category_name) AS category, count(*) AS n
  FROM b_orders_base o JOIN b_items i ON o.order_id = i.order_id
  JOIN b_products p ON i.product_id = p.product_id GROUP BY 1, 2),
fav AS (
  SELECT customer_id, category AS fav_category FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, category ASC) AS rn
    FROM fc) t WHERE rn = 1),
lastp AS (
  SELECT customer_id, max(order_purchase_timestamp) AS last_purchase,
         max(order_delivered_customer_date) AS last_delivery
  FROM b_orders GROUP BY 1),
ci AS (
  SELECT l.customer_id,
         {FLOOR_DAYS.format(a=ASOF_SQL, b='l.last_purchase')} AS days_since_last,
         {FLOOR_DAYS.format(a=ASOF_SQL, b='l.last_delivery')} AS days_since_delivery,
         f.fav_category
  FROM lastp l LEFT JOIN fav f ON l.customer_id = f.customer_id)
"""

SELLER_WEEK_CTES = f""", sw AS (
  SELECT i.order_id, i.seller_id, i.price,
         CAST(date_trunc('week', o.order_purchase_timestamp) AS DATE) AS week
  FROM b_items i JOIN b_orders_base o ON i.order_id = o.order_id),
wkr AS (
  SELECT sw.seller_id, sw.week, {int_avg('r.review_score')} AS avg_rating
  FROM sw JOIN b_reviews r ON sw.order_id = r.order_id GROUP BY 1, 2),
wks AS (
  SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY week) AS idx,
         coalesce(avg_rating < lag(avg_rating) OVER (PARTITION BY seller_id ORDER BY week), false) AS drp
  FROM wkr),
rdw AS (
  SELECT seller_id, max(idx) - max(CASE WHEN NOT drp THEN idx END) AS rating_drop_weeks,
         max(week) AS last_week
  FROM wks GROUP BY 1),
wkp AS (
  SELECT seller_id, week, {money_avg('price')} AS avg_price FROM sw GROUP BY 1, 2),
wkpr AS (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY week DESC) AS rn FROM wkp),
pinc AS (
  SELECT seller_id, max(CASE WHEN rn = 1 THEN week END) AS last_week,
         (max(CASE WHEN rn = 1 THEN avg_price END) - max(CASE WHEN rn = 2 THEN avg_price END))
           / NULLIF(max(CASE WHEN rn = 2 THEN avg_price END), 0) * CAST(100.0 AS DOUBLE)
           AS price_increase_pct
  FROM wkpr WHERE rn <= 2 GROUP BY 1),
act AS (
  SELECT i.seller_id, min(o.order_purchase_timestamp) AS first_order,
         count(DISTINCT i.order_id) AS total_orders,
         CAST(sum(CAST(i.is_returned AS INTEGER)) AS DOUBLE) / NULLIF(count(*), 0) AS return_rate
  FROM b_items i JOIN b_orders_base o ON i.order_id = o.order_id GROUP BY 1),
sinp AS (
  SELECT s.seller_id,
         coalesce({FLOOR_DAYS.format(a=ASOF_SQL, b='act.first_order')}, 0) AS days_on_platform,
         coalesce(act.total_orders, 0) AS total_orders,
         coalesce(act.return_rate, 0.0) AS return_rate
  FROM b_sellers s LEFT JOIN act ON s.seller_id = act.seller_id)
"""


# ---------------------------------------------------------------- inputs


@register("customer_inputs", with_views("SELECT * FROM ci", CUSTOMER_INPUTS_CTES))
def customer_inputs(spark, d):
    return IN.customer_inputs(from_testdata(spark, d))


@register("rating_drop_weeks", with_views("SELECT * FROM rdw", SELLER_WEEK_CTES))
def rating_drop_weeks(spark, d):
    return IN.rating_drop_weeks(from_testdata(spark, d))


@register("price_increase", with_views("SELECT * FROM pinc", SELLER_WEEK_CTES))
def price_increase(spark, d):
    return IN.price_increase(from_testdata(spark, d))


@register("seller_inputs", with_views("SELECT * FROM sinp", SELLER_WEEK_CTES))
def seller_inputs(spark, d):
    return IN.seller_inputs(from_testdata(spark, d))


# ---------------------------------------------------------------- rules


@register("score_band", with_views(f"""
SELECT order_id, {ORDER_SCORE_SQL} AS risk_score,
       CASE WHEN {ORDER_SCORE_SQL} >= 70 THEN 'high' WHEN {ORDER_SCORE_SQL} >= 40 THEN 'medium'
            ELSE 'low' END AS band
FROM b_orders_base
"""))
def score_band(spark, d):
    s = order_score(from_testdata(spark, d))
    return s.select("order_id", "risk_score", RU.score_band(F.col("risk_score")).alias("band"))


@register("bulky_flag", with_views("""
SELECT product_id, product_weight_g / CAST(1000.0 AS DOUBLE) AS weight_kg,
       coalesce(product_weight_g / CAST(1000.0 AS DOUBLE) >= 15.0, false) AS is_bulky,
       NOT coalesce(product_weight_g / CAST(1000.0 AS DOUBLE) >= 15.0, false) AS can_split,
       CASE WHEN coalesce(product_weight_g / CAST(1000.0 AS DOUBLE) >= 15.0, false)
            THEN 'bulky_single_piece' ELSE 'standard' END AS handling_category
FROM b_products
"""))
def bulky_flag(spark, d):
    return RU.bulky_flags(from_testdata(spark, d).products)


def churn_rule_table(b: Biz, scores: DataFrame | None = None) -> DataFrame:
    """Serving aggregate (no delivered filter) + derived inputs + score: ``scores``
    (customer_id, churn_prob) of a fitted model, or the stand-in."""
    agg = FE._churn_aggregate(b, delivered_only=False)
    scores = customer_score(b) if scores is None else scores.select("customer_id", "churn_prob")
    return (agg.join(scores, "customer_id")
               .join(IN.customer_inputs(b), "customer_id", "left")
               .select("customer_id", "churn_prob", "frequency",
                       F.coalesce("monetary", F.lit(500.0)).alias("monetary"),
                       F.coalesce("avg_review_score", F.lit(3.0)).alias("avg_review_score"),
                       "days_since_last", "days_since_delivery", "fav_category"))


_CHURN_RULE_CTES = CUSTOMER_INPUTS_CTES + f""", cs AS ({churn_agg_sql(delivered_only=False)}),
ct AS (
  SELECT cs.customer_id, {CUSTOMER_SCORE_SQL} AS churn_prob, cs.frequency,
         coalesce(cs.monetary, 500.0) AS monetary,
         coalesce(cs.avg_review_score, 3.0) AS avg_review_score,
         ci.days_since_last, ci.days_since_delivery, ci.fav_category
  FROM cs JOIN b_customers c ON cs.customer_id = c.customer_id
  LEFT JOIN ci ON cs.customer_id = ci.customer_id)
"""


CHURN_RULES_BODY = """
SELECT customer_id, 'rule1_vip' AS rule FROM ct WHERE churn_prob > 70 AND monetary > 2000
UNION ALL SELECT customer_id, 'rule2_comeback' FROM ct WHERE churn_prob > 70 AND NOT (monetary > 2000)
UNION ALL SELECT customer_id, 'rule3_survey' FROM ct WHERE churn_prob >= 50 AND churn_prob <= 70
UNION ALL SELECT customer_id, 'rule4_missyou' FROM ct WHERE frequency = 1 AND days_since_last > 90
UNION ALL SELECT customer_id, 'rule5_refund' FROM ct WHERE avg_review_score = 1.0
UNION ALL SELECT customer_id, 'rule6_suggest' FROM ct WHERE days_since_last > 60 AND fav_category IS NOT NULL
UNION ALL SELECT customer_id, 'rule7_review' FROM ct WHERE days_since_delivery = 3 AND avg_review_score = 0.0
"""
CHURN_RULE_CTES = _CHURN_RULE_CTES


@register("churn_rules", with_views(CHURN_RULES_BODY, CHURN_RULE_CTES))
def churn_rules(spark, d):
    return RU.churn_rules(churn_rule_table(from_testdata(spark, d)))


def seller_rule_table(b: Biz, clusters: DataFrame | None = None) -> DataFrame:
    """Seller measures for the rules, with the ``clusters`` (seller_id, cluster) of a fitted
    model or the stand-in. The (seller, order) facts feed four aggregates, so they are
    written once to the shared checkpoint folder. A seller whom no cluster is known of
    (too few orders to be clustered) is judged by the other measures."""
    facts = FE.materialize(FE.seller_order_facts(b))
    agg = FE.seller_aggregate(b, for_serving=True, facts=facts).select("seller_id", "cancellation_rate",
                                                                      "avg_rating")
    drops = IN.rating_drop_weeks(b, facts).select("seller_id", "rating_drop_weeks")
    inc = IN.price_increase(b, facts).select("seller_id", "price_increase_pct")
    clusters = seller_cluster(b) if clusters is None else clusters
    t = (IN.seller_inputs(b, facts).join(clusters, "seller_id", "left")
         .join(agg, "seller_id", "left").join(drops, "seller_id", "left")
         .join(inc, "seller_id", "left"))
    return t.withColumn("rating_drop_weeks",
                        F.coalesce(F.col("rating_drop_weeks"), RU.default_drop_weeks(F.col("avg_rating"))))


_SELLER_RULE_CTES = SELLER_WEEK_CTES + f""", sag AS ({seller_agg_sql(having=False)}),
st AS (
  SELECT si.seller_id, si.days_on_platform, si.total_orders, si.return_rate,
         CAST(s.s_suppkey % 4 AS INTEGER) AS cluster, sag.cancellation_rate,
         coalesce(rdw.rating_drop_weeks, CASE WHEN sag.avg_rating < 3.0 THEN 3 ELSE 0 END) AS rating_drop_weeks,
         pinc.price_increase_pct
  FROM sinp si JOIN b_sellers s ON si.seller_id = s.seller_id
  LEFT JOIN sag ON si.seller_id = sag.seller_id
  LEFT JOIN rdw ON si.seller_id = rdw.seller_id
  LEFT JOIN pinc ON si.seller_id = pinc.seller_id),
stv AS (
  SELECT *, (coalesce(cancellation_rate > 0.15, false) OR coalesce(price_increase_pct > 30, false)
             OR coalesce(return_rate > 0.10, false) OR coalesce(rating_drop_weeks >= 3, false)) AS viol
  FROM st)
"""


SELLER_RULES_BODY = """
SELECT seller_id, 'rule1_toxic' AS rule FROM stv WHERE cancellation_rate > 0.15
UNION ALL SELECT seller_id, 'rule2_price' FROM stv WHERE price_increase_pct > 30
UNION ALL SELECT seller_id, 'rule3_return' FROM stv WHERE return_rate > 0.10
UNION ALL SELECT seller_id, 'rule4_rating' FROM stv WHERE rating_drop_weeks >= 3
UNION ALL SELECT seller_id, 'rule5_star' FROM stv WHERE cluster IN (0, 3) AND NOT viol
UNION ALL SELECT seller_id, 'rule5_star_withheld' FROM stv WHERE cluster IN (0, 3) AND viol
UNION ALL SELECT seller_id, 'rule6_newbie' FROM stv WHERE days_on_platform < 30 AND total_orders = 0
"""
SELLER_RULE_CTES = _SELLER_RULE_CTES


@register("seller_rules", with_views(SELLER_RULES_BODY, SELLER_RULE_CTES))
def seller_rules(spark, d):
    return RU.seller_rules(seller_rule_table(from_testdata(spark, d)))


# ---------------------------------------------------------------- newest ids


def _with_pos(top: DataFrame, order) -> DataFrame:
    """Rank rows of an already limited (bounded) result in the same order."""
    from pyspark.sql import Window
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long"))


def newest_orders(b: Biz, n: int, statuses: tuple[str, ...] | None = None,
                  with_pos: bool = False) -> DataFrame:
    o = b.orders_nodates
    if statuses:
        o = o.where(F.col("order_status").isin(*statuses))
    order = [F.col("order_purchase_timestamp").desc_nulls_first(), F.col("order_id").asc()]
    top = o.orderBy(*order).limit(n).select("order_id", "customer_id", "order_purchase_timestamp")
    return _with_pos(top, order) if with_pos else top


def newest_item_sellers(b: Biz, n: int, with_pos: bool = False) -> DataFrame:
    j = (b.items.select("order_id", "order_item_id", "product_id", "seller_id")
         .join(b.orders_nodates.select("order_id", "order_purchase_timestamp"), "order_id"))
    order = [F.col("order_purchase_timestamp").desc_nulls_first(), F.col("order_id"),
             F.col("order_item_id"), F.col("product_id"), F.col("seller_id")]
    top = j.orderBy(*order).limit(n)
    if with_pos:
        return _with_pos(top, order)
    return top.select("seller_id", "order_id", "order_purchase_timestamp")


OPEN_STATUSES = ("processing", "shipped")
FOCUS_SIZE = 5


@register("open_orders_latest", with_views(f"""
SELECT order_id, customer_id, order_purchase_timestamp FROM b_orders_base
WHERE order_status IN ('processing', 'shipped')
ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id ASC LIMIT {FOCUS_SIZE + 10}
"""))
def open_orders_latest(spark, d):
    return newest_orders(from_testdata(spark, d), FOCUS_SIZE + 10, OPEN_STATUSES)


@register("customers_latest", with_views(f"""
SELECT order_id, customer_id, order_purchase_timestamp FROM b_orders_base
ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id ASC LIMIT {FOCUS_SIZE + 20}
"""))
def customers_latest(spark, d):
    return newest_orders(from_testdata(spark, d), FOCUS_SIZE + 20)


@register("sellers_latest", with_views(f"""
SELECT i.seller_id, i.order_id, o.order_purchase_timestamp
FROM b_items i JOIN b_orders_base o ON i.order_id = o.order_id
ORDER BY o.order_purchase_timestamp DESC NULLS FIRST, i.order_id, i.order_item_id, i.product_id, i.seller_id
LIMIT {FOCUS_SIZE + 20}
"""))
def sellers_latest(spark, d):
    return newest_item_sellers(from_testdata(spark, d), FOCUS_SIZE + 20)


# ---------------------------------------------------------------- encodings / metrics


@register("encode_category", with_views("""
SELECT payment_type, CAST(dense_rank() OVER (ORDER BY payment_type) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT payment_type FROM rb WHERE payment_type IS NOT NULL) t
""", f", rb AS ({RISK_BASE_SQL})"))
def encode_category(spark, d):
    return MT.encode_category(FE.risk_base(from_testdata(spark, d)), "payment_type")


@register("class_balance", with_views("""
SELECT model, label, n,
       CAST(sum(CASE WHEN label = 0 THEN n END) OVER (PARTITION BY model) AS DOUBLE)
         / NULLIF(sum(CASE WHEN label = 1 THEN n END) OVER (PARTITION BY model), 0) AS pos_weight
FROM (SELECT 'risk' AS model, is_risk AS label, count(*) AS n FROM rf GROUP BY 2
      UNION ALL SELECT 'churn', is_churn, count(*) FROM cfl GROUP BY 2) t
""", RISK_FEATURES_CTES + churn_features_ctes(churn_agg_sql())))
def class_balance(spark, d):
    b = from_testdata(spark, d)
    return (MT.class_balance(FE.risk_features(b), "is_risk", "risk")
            .unionByName(MT.class_balance(FE.churn_features(b), "is_churn", "churn")))


def fixed_predictions(b: Biz) -> DataFrame:
    """Delivered orders with their true risk label and a repeatable score."""
    lab = FE.risk_label(b).select("order_id", F.col("is_risk").alias("label"))
    s = order_score(b).select("order_id", (F.col("risk_score") / F.lit(100.0)).alias("score"))
    return (lab.join(s, "order_id")
               .withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0)))


_PRED_CTES = RISK_FEATURES_CTES + f""", pr AS (
  SELECT l.order_id, l.is_risk AS label, ({ORDER_SCORE_SQL.replace('o_orderkey', 'o.o_orderkey')}) / CAST(100.0 AS DOUBLE) AS score
  FROM (SELECT DISTINCT order_id, delivery_delay_days, review_score, is_risk FROM rf) l
  JOIN b_orders_base o ON l.order_id = o.order_id),
prp AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM pr),
cm AS (SELECT CAST(label AS INTEGER) AS y, CAST(prediction AS INTEGER) AS p, count(*) AS n FROM prp GROUP BY 1, 2),
cells AS (
  SELECT y AS k, CASE WHEN y = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN y = p THEN 0 ELSE n END AS fn FROM cm
  UNION ALL SELECT p, 0, CASE WHEN y = p THEN 0 ELSE n END, 0 FROM cm),
per AS (SELECT k, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM cells GROUP BY k),
rows_ AS (
  SELECT CAST(k AS VARCHAR) AS class_label,
         coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
         coalesce(CAST(tp AS DOUBLE) / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
         coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0) AS f1,
         tp + fn AS support, tp
  FROM per),
tot AS (
  SELECT sum(support) AS s, sum(tp) AS tp, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr,
         sum(f1) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr,
         sum(f1 * support) AS wf FROM rows_)
"""


@register("classification_report", with_views("""
SELECT class_label, precision, recall, f1, support FROM rows_
UNION ALL SELECT 'accuracy', NULL, NULL, CAST(tp AS DOUBLE) / CAST(s AS DOUBLE), s FROM tot
UNION ALL SELECT 'macro avg', sp / k, sr / k, sf / k, s FROM tot
UNION ALL SELECT 'weighted avg', wp / s, wr / s, wf / s, s FROM tot
""", _PRED_CTES))
def classification_report(spark, d):
    return MT.classification_report(fixed_predictions(from_testdata(spark, d)))


@register("roc_auc", with_views("""
SELECT CAST(u2 AS DOUBLE) / (CAST(2.0 AS DOUBLE) * CAST(positives AS DOUBLE) * CAST(negatives AS DOUBLE)) AS auc,
       positives, negatives
FROM (
  SELECT sum(pos * (2 * neg_below + neg)) AS u2, sum(pos) AS positives, sum(neg) AS negatives
  FROM (SELECT s, pos, neg,
               coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
        FROM (SELECT score AS s, sum(CAST(label AS BIGINT)) AS pos, sum(CAST(1 - label AS BIGINT)) AS neg
              FROM prp GROUP BY score) g) w) t
""", _PRED_CTES))
def roc_auc(spark, d):
    return MT.roc_auc(fixed_predictions(from_testdata(spark, d)))
