"""Rules and actions on fitted scores and clusters, and what SQL can state about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.operators import actions as AC
from tradewind.operators import ml as ML
from tradewind.operators import rules as RU
from tradewind.plans import ml_plans as MP
from tradewind.plans import rule_plans as RP
from tradewind.plans.alert_plans import decisions
from tradewind.plans.catalog import register
from tradewind.plans.feature_plans import churn_agg_sql
from tradewind.plans.oracle_views import with_views
from tradewind.sources.business import from_testdata

#: The reference's number of each segment.
SEGMENT_NUMBERS = {name: k for k, name in enumerate(ML.SEGMENTS)}


def churn_table(spark, d):
    return RP.churn_rule_table(from_testdata(spark, d), MP.scored_customers(spark, d))


def fitted_clusters(spark, d):
    """seller_id and the segment's number in the reference (premium 0, toxic 1, average 2, star 3)."""
    model, rows = MP.seller_model(spark, d)
    names = ML.cluster_names(ML.cluster_profile(model, rows))
    number = F.coalesce(*[F.when(F.col("segment") == s, F.lit(k)) for s, k in SEGMENT_NUMBERS.items()])
    return model.transform(rows).select("seller_id", "cluster").join(names.select("cluster", "segment"), "cluster").select(
        "seller_id", number.alias("cluster"))


@register("churn_rules_fitted")
def churn_rules_fitted(spark, d):
    """The customer rules on the fitted churn probabilities."""
    return RU.churn_rules(churn_table(spark, d))


@register("seller_rules_fitted")
def seller_rules_fitted(spark, d):
    """The seller rules on the fitted segments."""
    return RU.seller_rules(RP.seller_rule_table(from_testdata(spark, d), fitted_clusters(spark, d)))


@register("action_event_fitted")
def action_event_fitted(spark, d):
    """Action events of open orders by their fitted risk."""
    return AC.action_events(decisions(from_testdata(spark, d), MP.scored_orders(spark, d)))


@register("fitted_rules_check", with_views(
    f"SELECT 'customers' AS judged, (SELECT count(*) FROM ({churn_agg_sql(delivered_only=False)}) c) AS rows, CAST(0 AS BIGINT) AS broken "
    "UNION ALL SELECT 'sellers', (SELECT count(*) FROM b_sellers), 0"))
def fitted_rules_check(spark, d):
    """Every customer and seller is judged once, and the rules that depend on the
    model fire just where its scores and segments say so."""
    table = churn_table(spark, d)
    hits = RU.churn_rules(table).groupBy("customer_id").agg(F.collect_set("rule").alias("rules"))
    has = lambda rule: F.coalesce(F.array_contains("rules", rule), F.lit(False))
    p = F.col("churn_prob")
    off = (((p > 70) != (has("rule1_vip") | has("rule2_comeback"))) | (has("rule1_vip") & has("rule2_comeback"))
           | (p.between(50, 70) != has("rule3_survey")))
    out = table.join(hits, "customer_id", "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(off, F.lit(True))).alias("broken"))
    sellers = RP.seller_rule_table(from_testdata(spark, d), fitted_clusters(spark, d))
    found = RU.seller_rules(sellers).groupBy("seller_id").agg(F.collect_set("rule").alias("rules"))
    star = F.coalesce(F.col("cluster").isin(*RU.STAR_CLUSTERS), F.lit(False))
    wrong = (star != (has("rule5_star") | has(RU.STAR_WITHHELD))) | (has("rule5_star") & RU.seller_violation(sellers))
    more = sellers.join(found, "seller_id", "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("broken"))
    return out.select(F.lit("customers").alias("judged"), "*").unionByName(more.select(F.lit("sellers").alias("judged"), "*"))
