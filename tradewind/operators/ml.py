"""Model training, evaluation and batch scoring with ``pyspark.ml``.

* delivery risk: boosted trees on (weight, order value, weekday, payment code)
* churn: random forest on five customer aggregates
* seller segments: standardised features, k-means k = 4, best of 10 starts

Splits are stratified and exact (``split``): of each class, round(0.8 n) orders or
customers; an order's fan-out rows stay on one side. Class weights come from the
training part.
Only metrics and small model metadata reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.bins import bin_sql
from tradewind.functions.dates import weekday_mon0, weekday_sun0
from tradewind.operators import features as FE
from tradewind.operators import kmeans as KM
from tradewind.operators import metrics as MT
from tradewind.operators import rules as RU
from tradewind.operators import split as SP
from tradewind.session import shuffles_dropped, written
from tradewind.sources.business import Biz
from tradewind.sources.tables import spread

SEED = 42
TRAIN_SHARE = 0.8
# Reference hyper-parameters (fixed values).
RISK_TREES, RISK_DEPTH, RISK_RATE = 200, 5, 0.05
CHURN_TREES, CHURN_DEPTH = 200, 8
SELLER_K, SELLER_STARTS, SELLER_ITERATIONS = 4, 10, 300
# Lineage of the boosting state grows by one step per tree: checkpoint it to
# the shared folder every 25 trees (the 200-tree default writes 8 times;
# short runs need none).
CHECKPOINT_INTERVAL = 25

RISK_INPUTS = ["product_weight_g", "order_value", "day_of_week", "payment_code"]


def with_class_weight(df: DataFrame, label: str) -> tuple[DataFrame, float]:
    """weight = negatives / positives for label 1 (from the training part)."""
    c = df.where(F.col("part") == "train").groupBy(label).count().collect()
    counts = {r[label]: r["count"] for r in c}
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    w = (neg / pos) if pos else 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(w)).otherwise(F.lit(1.0))), w


# ---------------------------------------------------------------- risk


def risk_training_rows(b: Biz) -> DataFrame:
    """Written once, with the class of each order while its rows lie together; the median, the
    split and all that follows only scan."""
    with shuffles_dropped(b.orders.sparkSession):
        rows = FE.risk_features(b, lambda f: written(SP.with_class(f, "order_id", "is_risk")))
        return SP.stratified(rows, "order_id", "is_risk", TRAIN_SHARE, SEED, "_class")


#: Bins of a continuous input, the trees' own default number.
RISK_BINS = 32
#: Continuous inputs and the columns that hold their bins; the others are small integers as they are.
BIN_COLUMNS = {"product_weight_g": "product_weight_bin", "order_value": "order_value_bin"}
TREE_INPUTS = [BIN_COLUMNS.get(c, c) for c in RISK_INPUTS]
#: Partitions of the cells that the trees are fitted on, a fixed number: cells are bounded by the bins, not by the rows.
CELL_PARTITIONS = 2


def _bin_stage(train: DataFrame) -> SQLTransformer:
    """Adds the bins: how many thresholds lie below the value, the last bin if it is missing
    (not below or equal to any threshold, as in the trees)."""
    shares = [k / RISK_BINS for k in range(1, RISK_BINS)]
    at = train.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in BIN_COLUMNS]).first()
    parts = []
    for c, name in BIN_COLUMNS.items():
        limits = sorted({t for t in at[c] or [] if t == t})
        parts.append(f"CAST({bin_sql(f"coalesce(CAST({c} AS DOUBLE), double('NaN'))", limits)} AS DOUBLE) AS {name}")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_risk(b: Biz, trees: int = RISK_TREES) -> tuple[PipelineModel, DataFrame]:
    """Boosted trees see rows through their bins only, and rows of one cell (all bins and the
    label alike) have one gradient in every round. So the trees are fitted on cells, weighted
    by their rows: the same sums, and 200 rounds over a table that does not grow with the rows."""
    rows, pos_weight = with_class_weight(spread(risk_training_rows(b)), "is_risk")
    train = rows.where(F.col("part") == "train")
    bins = _bin_stage(train)
    n = F.count(F.lit(1)).cast("double")
    cells = bins.transform(train.select("payment_type", *[c for c in RISK_INPUTS if c != "payment_code"], "is_risk")).groupBy(
        "payment_type", *[c for c in TREE_INPUTS if c != "payment_code"], "is_risk").agg(
        (n * F.when(F.col("is_risk") == 1, F.lit(pos_weight)).otherwise(F.lit(1.0))).alias("weight"))
    cells = FE.materialize(cells.repartition(CELL_PARTITIONS, "payment_type", *BIN_COLUMNS.values()).sortWithinPartitions(*cells.columns))
    idx = StringIndexer(inputCol="payment_type", outputCol="payment_code",
                        stringOrderType="alphabetAsc", handleInvalid="keep").fit(cells)
    vec = VectorAssembler(inputCols=TREE_INPUTS, outputCol="features", handleInvalid="keep")
    # maxBins also sets how many rows the trees look at for their thresholds: here every cell, so each bin is a split.
    gbt = GBTClassifier(featuresCol="features", labelCol="is_risk", weightCol="weight",
                        maxIter=trees, maxDepth=RISK_DEPTH, stepSize=RISK_RATE, seed=SEED,
                        maxBins=max(RISK_BINS, math.isqrt(cells.count()) + 1), checkpointInterval=CHECKPOINT_INTERVAL)
    fitted = gbt.fit(vec.transform(idx.transform(cells)))
    return PipelineModel(stages=[idx, bins, vec, fitted]), rows


def tree_inputs(model: PipelineModel, rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and, under the names of ``RISK_INPUTS``, what the trees see of each row."""
    seen = PipelineModel(stages=model.stages[:-2]).transform(rows)
    return seen.select(*keys, *[F.col(t).alias(c) for t, c in zip(TREE_INPUTS, RISK_INPUTS, strict=True)])


def score_by_cell(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` and probability 1 of each as ``p1``, for many rows a cell: rows whose inputs the trees
    see alike have one score, so each distinct cell goes through the trees once and is joined back.
    The cells are bounded by the bins, payment classes and weekdays, whatever the rows."""
    seen = PipelineModel(stages=model.stages[:-2]).transform(rows)
    cells = PipelineModel(stages=model.stages[-2:]).transform(seen.select(*TREE_INPUTS).distinct())
    cells = cells.select(*[F.col(c).alias(f"cell_{c}") for c in TREE_INPUTS], prob1().alias("p1"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"cell_{c}")) for c in TREE_INPUTS])
    return seen.join(F.broadcast(cells), same).select(*rows.columns, "p1")


def payment_classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def known_payment(model: PipelineModel, col: str = "payment_type") -> F.Column:
    """Unseen payment types map to the first class, as the reference does."""
    labels = payment_classes(model)
    return F.when(F.col(col).isin(*labels), F.col(col)).otherwise(F.lit(labels[0]))


def prob1(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


# ---------------------------------------------------------------- churn

CHURN_INPUTS = FE.CHURN_FEATURES


def churn_training_rows(b: Biz) -> DataFrame:
    with shuffles_dropped(b.orders.sparkSession):
        return written(SP.stratified(FE.materialize(FE.churn_features(b)), "customer_id", "is_churn", TRAIN_SHARE, SEED))


def fit_churn(b: Biz, trees: int = CHURN_TREES) -> tuple[PipelineModel, DataFrame]:
    rows = spread(churn_training_rows(b).withColumn("frequency", F.col("frequency").cast("double")))
    rows, _ = with_class_weight(rows, "is_churn")
    vec = VectorAssembler(inputCols=CHURN_INPUTS, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="features", labelCol="is_churn", weightCol="weight",
                                numTrees=trees, maxDepth=CHURN_DEPTH, featureSubsetStrategy="sqrt",
                                seed=SEED, checkpointInterval=CHECKPOINT_INTERVAL,
                                cacheNodeIds=trees > CHECKPOINT_INTERVAL)
    model = Pipeline(stages=[vec, rf]).fit(rows.where(F.col("part") == "train"))
    return model, rows


# ---------------------------------------------------------------- sellers

#: Partitions of the rows that k-means is fitted on (one row a seller), a fixed number.
FIT_PARTITIONS = 8

SELLER_INPUTS = FE.SELLER_FEATURES


def fit_sellers(b: Biz, k: int = SELLER_K, starts: int = SELLER_STARTS) -> tuple[PipelineModel, DataFrame]:
    """Scaler + k-means; of ``starts`` starts, moved together, the one of the least cost."""
    rows = FE.seller_features(b).withColumn("total_orders", F.col("total_orders").cast("double")).persist()
    vec = VectorAssembler(inputCols=SELLER_INPUTS, outputCol="raw_features")
    sc = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    prep = Pipeline(stages=[vec, sc]).fit(rows)
    points = prep.transform(rows).select(F.col("seller_id").alias("id"), vector_to_array("features").alias("x"))
    points = points.repartition(FIT_PARTITIONS, "id").sortWithinPartitions("id").persist()
    centres, _, _ = KM.fit(points, k, starts, SELLER_ITERATIONS, SEED)
    points.unpersist()
    model = PipelineModel(stages=[prep.stages[0], prep.stages[1], KM.as_model(rows, centres, "features", "cluster")])
    return model, rows


def silhouette(model: PipelineModel, rows: DataFrame) -> float:
    """Spark's silhouette (squared Euclidean distance measure)."""
    pred = model.transform(rows)
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    return ev.evaluate(pred)


def euclidean_silhouette(model: PipelineModel, rows: DataFrame, sample: int | None = None) -> DataFrame:
    """The reference's silhouette: Euclidean distances, every seller against all (or a sample)."""
    return KM.euclidean_silhouette(model.transform(rows), "features", "cluster", sample)


def cluster_profile(model: PipelineModel, rows: DataFrame) -> DataFrame:
    pred = model.transform(rows)
    return pred.groupBy("cluster").agg(*[F.bround(F.avg(c), 2).alias(c) for c in SELLER_INPUTS],
                                       F.count("*").alias("sellers"))


# Segment names and the action the reference recommends.
SEGMENTS = {
    "premium": ("Premium Seller", "Show in the high-end catalogue", "success"),
    "toxic": ("Toxic Seller", "Lock the account / stop the partnership", "error"),
    "average": ("Average Seller", "Send revenue optimisation guide", "info"),
    "star": ("Star Seller", "Grant VIP badge / subsidy voucher", "success"),
}


def cluster_names(profile: DataFrame) -> DataFrame:
    """Name clusters by centroid: highest cancellation -> toxic; of the rest,
    highest order value -> premium; then most orders -> star; rest average.
    ``profile`` has one row per cluster (k rows)."""
    p = profile.collect()
    left = {r["cluster"]: r for r in p}
    names = {}
    for seg, key in (("toxic", "cancellation_rate"), ("premium", "avg_order_value"), ("star", "total_orders")):
        if not left:
            break
        c = max(left, key=lambda i: (left[i][key] if left[i][key] is not None else -math.inf, -i))
        names[c] = seg
        del left[c]
    for c in left:
        names[c] = "average"
    rows = [(c, seg) + SEGMENTS[seg] for c, seg in sorted(names.items())]
    return profile.sparkSession.createDataFrame(
        rows, "cluster int, segment string, name string, action string, severity string")


# ---------------------------------------------------------------- evaluation


def evaluate(model: PipelineModel, rows: DataFrame, label: str) -> DataFrame:
    """AUC (exact) and the classification report on the test part."""
    test = model.transform(rows.where(F.col("part") == "test"))
    # one scoring pass feeds both metrics (small: label, score, prediction)
    preds = test.select(F.col(label).alias("label"), prob1().alias("score"),
                        F.col("prediction").cast("int").alias("prediction")).persist()
    auc = MT.roc_auc(preds).select(F.lit("auc").alias("metric"), F.lit("all").alias("class_label"),
                                   F.col("auc").alias("value"))
    rep = MT.classification_report(preds)
    long = rep.select(F.lit("precision").alias("metric"), "class_label", F.col("precision").alias("value")) \
        .unionByName(rep.select(F.lit("recall").alias("metric"), "class_label", F.col("recall").alias("value"))) \
        .unionByName(rep.select(F.lit("f1").alias("metric"), "class_label", F.col("f1").alias("value"))) \
        .unionByName(rep.select(F.lit("support").alias("metric"), "class_label",
                                F.col("support").cast("double").alias("value")))
    return auc.unionByName(long)


def split_counts(rows: DataFrame, label: str, model: str) -> DataFrame:
    return rows.groupBy("part", F.col(label).alias("label")).count().select(
        F.lit(model).alias("model"), "part", "label", F.col("count").alias("n"))


# ---------------------------------------------------------------- batch scoring


def open_order_features(b: Biz, serving_dow: bool = False) -> DataFrame:
    """One feature row per open order: first item x payment row in a stated
    order (the reference reads one row per order), weekday Monday = 0 unless
    ``serving_dow`` asks for the serving page's Sunday = 0.

    An order's first row is chosen before the product join, on tables bucketed by
    order_id without an exchange, so one row an order is dealt by product_id. Items of
    unknown products do not count: orders that begin with one choose again among the others."""
    o = (b.orders_nodates.where(F.col("order_status").isin("processing", "shipped"))
         .select("order_id", "o_orderkey", "order_purchase_timestamp"))
    rows = (o.join(b.items.select("order_id", "order_item_id", "product_id", "seller_id"), "order_id")
             .join(b.payments.select("order_id", "payment_sequential", "payment_type", "payment_value"),
                   "order_id").where(F.col("product_id").isNotNull()))
    rank = ["order_item_id", "product_id", "seller_id", "payment_sequential"]

    def choose(rows: DataFrame) -> DataFrame:
        first = F.min(F.struct(*rank, *[c for c in rows.columns if c not in ("order_id", *rank)])).alias("first")
        return rows.groupBy("order_id").agg(first).select("order_id", "first.*")

    weights = b.products.groupBy("product_id").agg(F.min("product_weight_g").alias("product_weight_g"))
    known = choose(rows).join(weights, "product_id")
    again = choose(rows).join(weights, "product_id", "left_anti").select("order_id")
    others = choose(rows.join(again, "order_id", "left_semi").join(weights, "product_id"))
    first = known.unionByName(others)
    dow = weekday_sun0 if serving_dow else weekday_mon0
    return first.select("order_id", "o_orderkey", "seller_id", "payment_type",
                        F.col("payment_value").alias("order_value"),
                        "product_weight_g", dow("order_purchase_timestamp").alias("day_of_week"))


def score_orders(model: PipelineModel, feats: DataFrame) -> DataFrame:
    f = feats.withColumn("payment_type", known_payment(model))
    p = model.transform(f)
    score = prob1() * F.lit(100.0)
    return p.select("order_id", "seller_id", score.alias("risk_score"),
                    RU.score_band(score).alias("band"), F.col("prediction").cast("int").alias("predicted"))


def customer_serving_features(b: Biz) -> DataFrame:
    agg = FE._churn_aggregate(b, delivered_only=False)
    return agg.select("customer_id", F.col("frequency").cast("double").alias("frequency"),
                      F.coalesce("monetary", F.lit(500.0)).alias("monetary"),
                      F.coalesce("avg_review_score", F.lit(3.0)).alias("avg_review_score"),
                      F.coalesce("avg_freight_value", F.lit(50.0)).alias("avg_freight_value"),
                      F.coalesce("avg_delivery_delay", F.lit(0.0)).alias("avg_delivery_delay"))


def score_customers(model: PipelineModel, feats: DataFrame) -> DataFrame:
    p = model.transform(feats)
    score = prob1() * F.lit(100.0)
    return p.select("customer_id", score.alias("churn_prob"), RU.score_band(score).alias("band"),
                    F.col("prediction").cast("int").alias("predicted"))


def seller_serving_features(b: Biz) -> DataFrame:
    agg = FE.seller_aggregate(b, for_serving=True)
    return agg.select("seller_id", F.col("total_orders").cast("double").alias("total_orders"),
                      F.coalesce("avg_rating", F.lit(4.0)).alias("avg_rating"),
                      F.coalesce("avg_order_value", F.lit(150.0)).alias("avg_order_value"),
                      F.coalesce("avg_delay_days", F.lit(0.0)).alias("avg_delay_days"),
                      F.coalesce("cancellation_rate", F.lit(0.0)).alias("cancellation_rate"))


def score_sellers(model: PipelineModel, feats: DataFrame) -> DataFrame:
    p = model.transform(feats)
    return p.select("seller_id", "cluster",
                    (F.col("total_orders") * F.col("avg_order_value")).alias("revenue_estimate"))
