"""The risk trees fitted on weighted cells equal those fitted on every row."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tests.conftest import make_biz
from tradewind.operators import ml as ML

KINDS = ("boleto", "credit_card", "voucher")


def _biz(spark, n=900):
    orders = [{"order_id": f"o{k}", "purchase": f"2024-01-{1 + k % 28:02d}", "delivered": "2024-03-01" if k * 7 % 5 < 2 else "2024-01-29",
               "estimated": "2024-02-01"} for k in range(n)]
    return make_biz(spark, orders, items=[(f"o{k}", 1, f"p{k % 60}", "s1", 1.0, 1.0, False) for k in range(n)],
                    payments=[(f"o{k}", 1, KINDS[k * k % 3], None if k % 97 == 0 else float(k * 31 % 400)) for k in range(n)],
                    reviews=[(f"o{k}", 1 + (k * k // 3 + k % 60 // 20) % 5) for k in range(n)],
                    products=[(f"p{k}", "c", None if k == 7 else 100.0 + 37 * k) for k in range(60)])


def test_cells_give_the_trees_of_the_rows(spark):
    model, rows = ML.fit_risk(_biz(spark), trees=4)
    train = rows.where(F.col("part") == "train")
    seen = ML.tree_inputs(model, train, "is_risk", "weight")
    assert 0 < seen.where("is_risk = 1").count() < seen.count()
    vec = VectorAssembler(inputCols=ML.RISK_INPUTS, outputCol="features", handleInvalid="keep")
    whole = GBTClassifier(labelCol="is_risk", weightCol="weight", maxIter=4, maxDepth=ML.RISK_DEPTH, stepSize=ML.RISK_RATE, seed=ML.SEED,
                          maxBins=ML.RISK_BINS).fit(vec.transform(seen))
    by_row = whole.transform(vec.transform(ML.tree_inputs(model, rows, "order_id"))).select("order_id", ML.prob1().alias("p"))
    off = model.transform(rows).select("order_id", ML.prob1().alias("q")).join(by_row, "order_id").where("abs(p - q) > 1e-9")
    assert off.count() == 0
    assert len({t.numNodes for t in whole.trees}) and whole.trees[0].numNodes > 3


def test_bins_of_missing_values_and_of_limits(spark):
    model, rows = ML.fit_risk(_biz(spark, 300), trees=1)
    at = rows.where("order_value IS NOT NULL").selectExpr("percentile_approx(order_value, 0.5) AS m").first()["m"]
    df = spark.createDataFrame([(1, at, 500.0, 0, "voucher"), (2, None, None, 0, "voucher"), (3, 1e9, 1e9, 0, "voucher")],
                               "id int, order_value double, product_weight_g double, day_of_week int, payment_type string")
    got = {r["id"]: (r["order_value"], r["product_weight_g"]) for r in ML.tree_inputs(model, df, "id").collect()}
    assert got[2] == got[3]  # a missing value is above every threshold, as in the trees
    assert got[1][0] < got[3][0] <= ML.RISK_BINS - 1


def test_scores_by_cell_are_those_of_every_row(spark):
    model, rows = ML.fit_risk(_biz(spark, 300), trees=3)
    rows = rows.select("order_id", "payment_type", "order_value", "product_weight_g", "day_of_week")
    rows = rows.unionByName(rows).unionByName(spark.createDataFrame([("x", "voucher", None, None, None), ("y", "new", float("nan"), 1e9, 3)], rows.schema))
    got = ML.score_by_cell(model, rows)
    assert got.columns == [*rows.columns, "p1"]
    want = model.transform(rows).select(*rows.columns, ML.prob1().alias("p1"))
    assert got.count() == want.count() == rows.count()
    assert got.exceptAll(want).count() == 0
    # The trees see distinct cells only: the exploded options of a whole order book are many rows a cell.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" in plan[plan.index("Join"):]
