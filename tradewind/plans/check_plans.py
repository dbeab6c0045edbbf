"""Checkable forms of the model queries: what SQL can state about them.

A fitted model's numbers differ from any SQL text, but the rows it must cover,
the ranges it must keep and the sums that must hold do not. Each query gives one
row a model: how many rows it scored, and how many of them break the rule (0).
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tradewind.operators import ml as ML
from tradewind.operators import tree_attribution as TA
from tradewind.operators import whatif as WI
from tradewind.plans import ml_plans as MP
from tradewind.plans.catalog import register
from tradewind.plans.feature_plans import RISK_BASE_SQL, SELLER_FEATURES_CTES, churn_agg_sql, seller_agg_sql
from tradewind.plans.oracle_views import with_views
from tradewind.session import scratch_dir
from tradewind.sources.business import from_testdata

_OPEN_ORDERS = """(SELECT count(DISTINCT o.order_id) FROM b_orders_base o JOIN b_items i ON o.order_id = i.order_id
  JOIN b_payments p ON o.order_id = p.order_id JOIN b_products r ON i.product_id = r.product_id
  WHERE o.order_status IN ('processing', 'shipped'))"""
_CUSTOMERS = f"(SELECT count(*) FROM ({churn_agg_sql(delivered_only=False)}) c)"
_TRAINED_CUSTOMERS = f"(SELECT count(*) FROM ({churn_agg_sql()}) c)"
_SELLERS = f"(SELECT count(*) FROM ({seller_agg_sql(having=False)}) s)"
_TRAINED_SELLERS = "(SELECT count(*) FROM sfe)"
_RISK_ROWS = f"(SELECT count(*) FROM ({RISK_BASE_SQL}) r)"


def _check(df, bad):
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("broken"))


@register("score_check", with_views(
    f"SELECT 'orders' AS scored, {_OPEN_ORDERS} AS rows, CAST(0 AS BIGINT) AS broken UNION ALL SELECT 'customers', {_CUSTOMERS}, 0 "
    f"UNION ALL SELECT 'sellers', {_SELLERS}, 0"))
def score_check(spark, d):
    """Every open order, customer and seller has one score in range."""
    out_of = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 100)
    parts = [("orders", MP.score_orders(spark, d), out_of("risk_score")),
             ("customers", MP.score_customers(spark, d), out_of("churn_prob")),
             ("sellers", MP.score_sellers(spark, d), ~F.col("cluster").between(0, ML.SELLER_K - 1))]
    out = None
    for name, df, bad in parts:
        row = _check(df, bad).select(F.lit(name).alias("scored"), "rows", "broken")
        out = row if out is None else out.unionByName(row)
    return out


@register("whatif_check", with_views(f"SELECT {_OPEN_ORDERS} AS rows, CAST(0 AS BIGINT) AS broken"))
def whatif_check(spark, d):
    """The best option of every open order is no worse than the order as it is."""
    return _check(MP.whatif_best(spark, d), F.col("best_risk") > F.col("base_risk"))


@register("attribution_check", with_views(
    f"SELECT 'risk' AS model, {_OPEN_ORDERS} AS rows, CAST(0 AS BIGINT) AS broken UNION ALL SELECT 'churn', {_CUSTOMERS}, 0 "
    f"UNION ALL SELECT 'seller', {_TRAINED_SELLERS}, 0", SELLER_FEATURES_CTES))
def attribution_check(spark, d):
    """For every explained row the parts add up to score minus base."""
    out = None
    for name, fn, key in (("risk", MP.attribution_risk, "order_id"), ("churn", MP.attribution_churn, "customer_id"),
                          ("seller", MP.attribution_seller, "seller_id")):
        sums = fn(spark, d).groupBy(key).agg(F.sum("phi").alias("s"), F.max("full_value").alias("full"), F.max("base_value").alias("base"))
        row = _check(sums, F.abs(F.col("s") - (F.col("full") - F.col("base"))) > 1e-9).select(F.lit(name).alias("model"), "rows", "broken")
        out = row if out is None else out.unionByName(row)
    return out


@register("attribution_whatif_check", with_views(
    f"SELECT {_OPEN_ORDERS} * {len(WI.SCENARIOS)} AS rows, CAST(0 AS BIGINT) AS broken"))
def attribution_whatif_check(spark, d):
    """The differences of the parts add up to the difference of the margins, and the
    margins' risks differ by the simulation's ``risk_diff``."""
    keys = ["order_id", "scenario"]
    sums = MP.attribution_whatif(spark, d).groupBy(*keys).agg(
        F.sum("phi_diff").alias("s"), F.max("sim_margin").alias("sim"), F.max("base_margin").alias("base"), F.max("risk_diff").alias("told"))
    both = sums.join(MP.whatif_delta(spark, d), keys, "full")
    bad = (F.abs(F.col("s") - (F.col("sim") - F.col("base"))) > 1e-9) | (F.abs(F.col("told") - F.col("risk_diff")) > 1e-6)
    return _check(both, F.coalesce(bad, F.lit(True)))


@register("explainer_check", with_views(
    f"SELECT 'risk' AS model, {_OPEN_ORDERS} AS rows, CAST(0 AS BIGINT) AS broken UNION ALL SELECT 'churn', {_CUSTOMERS}, 0"))
def explainer_check(spark, d):
    """The bundle holds its explainer. Saved and loaded back, it explains every
    open order and customer as before, and the parts explain the model's own margin."""
    out = None
    for name, (model, ex), inputs, key in (
            ("risk", MP.risk_explainer(spark, d), lambda m: MP.coded_orders(spark, d, m), "order_id"),
            ("churn", MP.churn_explainer(spark, d), lambda m: ML.customer_serving_features(from_testdata(spark, d)), "customer_id")):
        path = scratch_dir(spark, f"models/{uuid.uuid4().hex}/{name}")
        TA.save_bundle(model, ex, path)
        loaded, again = TA.load_bundle(spark, path)
        rows = inputs(model)
        stage = loaded.stages[-1]
        scored = VectorAssembler(inputCols=ex.features, outputCol="features", handleInvalid="keep").transform(rows)
        margin = stage.transform(scored).select(key, TA.margin(stage, scored).alias("margin"))
        first = TA.attribute(rows, [key], ex).select(key, F.col("phi").alias("first"), F.col("base_value").alias("first_base"))
        both = TA.attribute(inputs(loaded), [key], again).join(first, key, "full").join(margin, key, "full")
        off = F.exists(F.zip_with("phi", "first", lambda a, b: F.abs(a - b)), lambda x: x > 1e-12)
        bad = off | (F.abs(F.col("base_value") - F.col("first_base")) > 1e-12) | (F.abs(F.col("full_value") - F.col("margin")) > 1e-9)
        row = _check(both, F.coalesce(bad, F.lit(True))).select(F.lit(name).alias("model"), "rows", "broken")
        out = row if out is None else out.unionByName(row)
    return out


@register("bundle_check", with_views(
    f"SELECT 'risk' AS model, {_RISK_ROWS} AS rows, CAST(0 AS BIGINT) AS broken UNION ALL SELECT 'churn', {_TRAINED_CUSTOMERS}, 0 "
    f"UNION ALL SELECT 'seller', {_TRAINED_SELLERS}, 0", SELLER_FEATURES_CTES))
def bundle_check(spark, d):
    """The three bundles (encoder or scaler included), saved to the shared folder and
    loaded back, give every training row the result of the original."""
    out = None
    for name, (model, rows), key in (("risk", MP.risk_model(spark, d), ML.prob1()), ("churn", MP.churn_model(spark, d), ML.prob1()),
                                     ("seller", MP.seller_model(spark, d), F.col("cluster"))):
        path = scratch_dir(spark, f"models/{uuid.uuid4().hex}/{name}")
        model.write().overwrite().save(path)
        both = PipelineModel.load(path).transform(model.transform(rows).select(*rows.columns, key.alias("first")))
        row = _check(both, F.coalesce(key != F.col("first"), F.lit(True))).select(F.lit(name).alias("model"), "rows", "broken")
        out = row if out is None else out.unionByName(row)
    return out


_PARTS = """SELECT '{model}' AS model, cls AS label, count(*) AS units, CAST(floor(count(*) * 0.8 + 0.5) AS BIGINT) AS train, CAST(0 AS BIGINT) AS torn
FROM (SELECT {key}, max({label}) AS cls FROM {table} GROUP BY 1) u GROUP BY 2"""


@register("split_check", with_views(
    _PARTS.format(model="risk", key="order_id", label="is_risk", table="rf") + " UNION ALL "
    + _PARTS.format(model="churn", key="customer_id", label="is_churn", table="cfl"), MP.SPLIT_CTES))
def split_check(spark, d):
    """M2: of each class exactly round(0.8 n) units train, and no unit is on both sides."""
    b = from_testdata(spark, d)
    out = None
    for name, rows, key, label in (("risk", ML.risk_training_rows(b), "order_id", "is_risk"), ("churn", ML.churn_training_rows(b), "customer_id", "is_churn")):
        units = rows.groupBy(key).agg(F.max(label).alias("label"), F.min("part").alias("lo"), F.max("part").alias("hi"))
        row = units.groupBy("label").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("hi") == "train").alias("train"),
                                         F.count_if(F.col("lo") != F.col("hi")).alias("torn")).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out
