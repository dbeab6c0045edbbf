"""Training, evaluation, scoring, what-if and attribution queries.

Models are fitted once per (application, kind, data folder, size), at the
reference's sizes (200 trees, 300 k-means iterations).
"""

from __future__ import annotations

import threading
import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tradewind.operators import attribution as AT
from tradewind.operators import features as FE
from tradewind.operators import ml as ML
from tradewind.operators import tree_attribution as TA
from tradewind.operators import whatif as WI
from tradewind.plans.catalog import register
from tradewind.plans.feature_plans import RISK_FEATURES_CTES, SELLER_FEATURES_CTES, churn_agg_sql, churn_features_ctes
from tradewind.plans.oracle_views import with_views
from tradewind.session import scratch_dir, shuffles_dropped
from tradewind.sources.business import from_testdata

_CACHE: dict = {}
_LOCK = threading.RLock()  # one fit per model kind and data folder


def _key(spark, kind, d, extra=None):
    return (spark.sparkContext.applicationId, kind, d, extra)


def risk_model(spark, d, trees=ML.RISK_TREES):
    k = _key(spark, "risk", d, trees)
    with _LOCK:
        if k not in _CACHE:
            with shuffles_dropped(spark):
                _CACHE[k] = ML.fit_risk(from_testdata(spark, d), trees)
        return _CACHE[k]


def churn_model(spark, d, trees=ML.CHURN_TREES):
    k = _key(spark, "churn", d, trees)
    with _LOCK:
        if k not in _CACHE:
            with shuffles_dropped(spark):
                _CACHE[k] = ML.fit_churn(from_testdata(spark, d), trees)
        return _CACHE[k]


def seller_model(spark, d):
    k = _key(spark, "seller", d)
    with _LOCK:
        if k not in _CACHE:
            with shuffles_dropped(spark):
                _CACHE[k] = ML.fit_sellers(from_testdata(spark, d))
        return _CACHE[k]


# ---------------------------------------------------------------- training / evaluation


def _split_sql(model, table, key, label):
    """Rows of each part: of each class, the units with the smallest hashes."""
    return f"""SELECT '{model}' AS model, part, {label} AS label, count(*) AS n FROM (
  SELECT r.{label}, CASE WHEN u.nth <= floor(u.units * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS part
  FROM {table} r JOIN (
    SELECT unit, row_number() OVER (PARTITION BY cls ORDER BY md5(unit || ':{ML.SEED}')) AS nth, count(*) OVER (PARTITION BY cls) AS units
    FROM (SELECT {key} AS unit, max({label}) AS cls FROM {table} GROUP BY 1) c) u ON u.unit = r.{key}) p GROUP BY 2, 3"""


SPLIT_CTES = RISK_FEATURES_CTES + churn_features_ctes(churn_agg_sql())


@register("split_counts", with_views(_split_sql("risk", "rf", "order_id", "is_risk") + " UNION ALL " + _split_sql("churn", "cfl", "customer_id", "is_churn"), SPLIT_CTES))
def split_counts(spark, d):
    b = from_testdata(spark, d)
    return (ML.split_counts(ML.risk_training_rows(b), "is_risk", "risk")
            .unionByName(ML.split_counts(ML.churn_training_rows(b), "is_churn", "churn")))


@register("risk_train_metrics")
def risk_train_metrics(spark, d):
    model, rows = risk_model(spark, d)
    return ML.evaluate(model, rows, "is_risk")


@register("churn_train_metrics")
def churn_train_metrics(spark, d):
    model, rows = churn_model(spark, d)
    return ML.evaluate(model, rows, "is_churn")


@register("model_roundtrip")
def model_roundtrip(spark, d):
    """Save the risk pipeline to the shared folder, load it back and check
    that the reloaded model scores the test rows identically."""
    model, rows = risk_model(spark, d)
    path = scratch_dir(spark, f"models/{uuid.uuid4().hex}/risk")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    test = rows.where(F.col("part") == "test")
    a = model.transform(test).select("order_id", ML.prob1().alias("p"))
    b = loaded.transform(test).select("order_id", ML.prob1().alias("p"))
    # multiset difference both ways: 0 and 0 when the scores are identical
    return spark.range(1).select(
        test.select(F.count("*")).scalar().alias("rows"),
        a.exceptAll(b).select(F.count("*")).scalar().alias("only_original"),
        b.exceptAll(a).select(F.count("*")).scalar().alias("only_reloaded"))


@register("seller_clusters")
def seller_clusters(spark, d):
    model, rows = seller_model(spark, d)
    return model.transform(rows).select("seller_id", "cluster")


@register("seller_silhouette")
def seller_silhouette(spark, d):
    model, rows = seller_model(spark, d)
    s = ML.silhouette(model, rows)
    squared = spark.createDataFrame([("squared_euclidean", float(s))], "distance string, silhouette double")
    return squared.unionByName(ML.euclidean_silhouette(model, rows).select(F.lit("euclidean").alias("distance"), "silhouette"))


@register("cluster_profile")
def cluster_profile(spark, d):
    model, rows = seller_model(spark, d)
    return ML.cluster_profile(model, rows)


@register("cluster_named")
def cluster_named(spark, d):
    model, rows = seller_model(spark, d)
    return ML.cluster_names(ML.cluster_profile(model, rows))


_SCALED_SQL = ", ".join(
    f"round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM sfe)) / "
    f"(SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM sfe), 9) AS {c}"
    for c in FE.SELLER_FEATURES)


@register("seller_scaled", with_views(f"SELECT seller_id, {_SCALED_SQL} FROM sfe", SELLER_FEATURES_CTES))
def seller_scaled(spark, d):
    """(x - mean) / population deviation per feature; the statistics are
    scalar subqueries (distributed partial aggregates, one value each)."""
    sf = FE.seller_features(from_testdata(spark, d))
    cols = []
    for c in FE.SELLER_FEATURES:
        x = F.col(c).cast("double")
        mu = sf.select(F.avg(x)).scalar()
        sd = sf.select(F.stddev_pop(x)).scalar()
        cols.append(F.round((x - mu) / sd, 9).alias(c))
    return sf.select("seller_id", *cols)


# ---------------------------------------------------------------- scoring


def scored_orders(spark, d):
    model, _ = risk_model(spark, d)
    return ML.score_orders(model, ML.open_order_features(from_testdata(spark, d)))


def scored_customers(spark, d):
    model, _ = churn_model(spark, d)
    return ML.score_customers(model, ML.customer_serving_features(from_testdata(spark, d)))


@register("score_orders")
def score_orders(spark, d):
    return scored_orders(spark, d)


@register("score_customers")
def score_customers(spark, d):
    return scored_customers(spark, d)


@register("score_sellers")
def score_sellers(spark, d):
    model, _ = seller_model(spark, d)
    return ML.score_sellers(model, ML.seller_serving_features(from_testdata(spark, d)))


@register("whatif_best")
def whatif_best(spark, d):
    model, _ = risk_model(spark, d)
    return WI.best_scenarios(model, ML.open_order_features(from_testdata(spark, d)))


@register("whatif_delta")
def whatif_delta(spark, d):
    model, _ = risk_model(spark, d)
    return WI.scenario_deltas(model, ML.open_order_features(from_testdata(spark, d)))


# ---------------------------------------------------------------- attribution

def risk_explainer(spark, d):
    model, _ = risk_model(spark, d)
    k = _key(spark, "risk-explainer", d)
    with _LOCK:
        if k not in _CACHE:
            _CACHE[k] = TA.explainer(spark, model.stages[-1], ML.RISK_INPUTS)
        return model, _CACHE[k]


def churn_explainer(spark, d):
    model, _ = churn_model(spark, d)
    k = _key(spark, "churn-explainer", d)
    with _LOCK:
        if k not in _CACHE:
            _CACHE[k] = TA.explainer(spark, model.stages[-1], ML.CHURN_INPUTS)
        return model, _CACHE[k]


def coded_orders(spark, d, model):
    """Open orders with the inputs that the trees see."""
    feats = ML.open_order_features(from_testdata(spark, d)).withColumn("payment_type", ML.known_payment(model))
    return ML.tree_inputs(model, feats, "order_id")


@register("attribution_risk")
def attribution_risk(spark, d):
    """Path-dependent log-odds attribution for every open order."""
    model, ex = risk_explainer(spark, d)
    return TA.long_form(TA.attribute(coded_orders(spark, d, model), ["order_id"], ex), ["order_id"], ex)


@register("attribution_churn")
def attribution_churn(spark, d):
    """Path-dependent attribution of the class-1 probability for every customer."""
    _, ex = churn_explainer(spark, d)
    feats = ML.customer_serving_features(from_testdata(spark, d))
    return TA.long_form(TA.attribute(feats, ["customer_id"], ex), ["customer_id"], ex)


@register("attribution_whatif")
def attribution_whatif(spark, d):
    """Attribution of every simulated order, beside that of the order as it is: for
    each order, scenario and feature both parts and their difference."""
    model, ex = risk_explainer(spark, d)
    rows = WI.scenario_rows(model, ML.open_order_features(from_testdata(spark, d)))
    coded = ML.tree_inputs(model, rows, "order_id", "scenario")
    parts = TA.attribute(coded, ["order_id", "scenario"], ex)
    base = parts.where(F.col("scenario") == WI.BASELINE).select("order_id", F.col("phi").alias("base_phi"), F.col("full_value").alias("base_margin"))
    both = parts.where(F.col("scenario") != WI.BASELINE).join(base, "order_id")
    each = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in ex.features]).alias("feature"), F.col("phi"), F.col("base_phi"))).alias("p")
    risk = lambda m: F.lit(100.0) / (1 + F.exp(-F.col(m)))
    return both.select("order_id", "scenario", each, F.col("full_value").alias("sim_margin"), "base_margin",
                       (risk("full_value") - risk("base_margin")).alias("risk_diff")).select(
        "order_id", "scenario", "p.feature", "p.phi", "p.base_phi", (F.col("p.phi") - F.col("p.base_phi")).alias("phi_diff"),
        "base_margin", "sim_margin", "risk_diff")


@register("attribution_seller")
def attribution_seller(spark, d):
    """Attribution of 'stays in its own cluster' (0/1) in scaled space."""
    model, rows = seller_model(spark, d)
    prep = PipelineModel(stages=model.stages[:2])
    km = model.stages[2]
    scaled_cols = [f"z_{c}" for c in ML.SELLER_INPUTS]
    sc = prep.transform(rows)
    sc = km.transform(sc).withColumnRenamed("cluster", "own_cluster")
    arr = vector_to_array("features")
    sc = sc.select("seller_id", "own_cluster", *[arr[i].alias(n) for i, n in enumerate(scaled_cols)])
    bg = AT.kmeans_background(sc, scaled_cols)

    def score(df):
        from pyspark.ml.feature import VectorAssembler
        v = VectorAssembler(inputCols=scaled_cols, outputCol="features").transform(df)
        return km.transform(v).withColumn("value", (F.col("cluster") == F.col("own_cluster")).cast("double"))
    return AT.shapley(sc, "seller_id", scaled_cols, bg, score, carry=("own_cluster",))


# ---------------------------------------------------------------- monitor

RISK_ALERT = 70.0
CHURN_ALERT = 50.0


@register("monitor_counts")
def monitor_counts(spark, d):
    """Open orders with risk > 70 and customers with churn > 50 (one row;
    each count is a distributed aggregate used as a scalar subquery)."""
    o = scored_orders(spark, d)
    c = scored_customers(spark, d)
    return spark.range(1).select(
        o.select(F.count_if(F.col("risk_score") > RISK_ALERT)).scalar().alias("risk_count"),
        c.select(F.count_if(F.col("churn_prob") > CHURN_ALERT)).scalar().alias("churn_count"))


@register("delivery_alerts")
def delivery_alerts(spark, d):
    """Feed messages for open orders scored above 70 (the monitor's output)."""
    from tradewind.operators.alerts import route
    from tradewind.sources.alert_source import MSG_DELIVERY
    import json
    head, tail = json.loads('"' + MSG_DELIVERY[0] + '"'), json.loads('"' + MSG_DELIVERY[1] + '"')
    o = scored_orders(spark, d).where(F.col("risk_score") > RISK_ALERT)
    msg = F.concat(F.lit(head), F.substring("order_id", 1, 12), F.lit(tail))
    payload = F.to_json(F.struct(
        F.col("order_id"), F.round("risk_score", 2).alias("risk_score"),
        F.when(F.col("risk_score") >= 90, "critical").otherwise("warning").alias("type"),
        msg.alias("message")))
    return o.select("order_id", "risk_score", payload.alias("raw"), route(msg).alias("route"))
