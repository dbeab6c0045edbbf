"""Model-quality metrics as aggregate jobs.

Only confusion counts or per-score counts leave the executors; every
window here runs over one row per class or per distinct score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def encode_category(values: DataFrame, column: str) -> DataFrame:
    """Alphabetical codes 0..k-1 (LabelEncoder / StringIndexer alphabetAsc).

    The window runs over the distinct values only.
    """
    d = values.select(column).where(F.col(column).isNotNull()).distinct()
    return d.select(column, (F.dense_rank().over(Window.orderBy(column)) - 1).alias("code"))


def class_balance(labelled: DataFrame, label: str, model: str) -> DataFrame:
    """Rows (model, label, n, pos_weight) with pos_weight = negatives / positives."""
    c = labelled.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))
    neg = F.sum(F.when(F.col("label") == 0, F.col("n"))).over(w)
    pos = F.sum(F.when(F.col("label") == 1, F.col("n"))).over(w)
    return c.select(F.lit(model).alias("model"), "label", "n",
                    F.try_divide(neg.cast("double"), pos).alias("pos_weight"))


def classification_report(preds: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages (zero division -> 0.0), from the confusion counts."""
    cm = preds.groupBy(F.col(label).cast("int").alias("y"),
                       F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    # Each confusion cell counts toward its true class (tp or fn) and, when
    # wrong, toward its predicted class (fp): explode, then sum per class.
    hit = F.col("y") == F.col("p")
    cells = F.array(
        F.struct(F.col("y").alias("k"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("tp"),
                 F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")))
    per = (cm.select(F.explode(cells).alias("c"))
             .groupBy(F.col("c.k").alias("k"))
             .agg(F.sum("c.tp").alias("tp"), F.sum("c.fp").alias("fp"), F.sum("c.fn").alias("fn")))
    zdiv = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = per.select(F.col("k").cast("string").alias("class_label"),
                      zdiv(tp, tp + fp).alias("precision"),
                      zdiv(tp, tp + fn).alias("recall"),
                      zdiv(2 * tp, 2 * tp + fp + fn).alias("f1"),
                      (tp + fn).alias("support"), tp.alias("tp"))
    tot = rows.agg(F.sum("support").alias("s"), F.sum("tp").alias("tp"),
                   F.count("*").alias("k"),
                   F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                   F.sum(F.col("precision") * F.col("support")).alias("wp"),
                   F.sum(F.col("recall") * F.col("support")).alias("wr"),
                   F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("class_label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     (F.col("tp").cast("double") / F.col("s").cast("double")).alias("f1"),
                     F.col("s").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class_label"),
                       (F.col("sp") / F.col("k")).alias("precision"),
                       (F.col("sr") / F.col("k")).alias("recall"),
                       (F.col("sf") / F.col("k")).alias("f1"), F.col("s").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class_label"),
                          (F.col("wp") / F.col("s")).alias("precision"),
                          (F.col("wr") / F.col("s")).alias("recall"),
                          (F.col("wf") / F.col("s")).alias("f1"), F.col("s").alias("support"))
    return rows.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)


#: Score ranges whose running sums are taken side by side.
AUC_RANGES = 256


def roc_auc(preds: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC (ties count one half) by the rank-sum form.

    Scores are cut at approximate quantiles into ``AUC_RANGES`` ranges. Inside a
    range a window sums over its distinct scores; the totals of the ranges (a
    fixed number of rows) give each range's offset. No task holds all scores.
    The numerator is kept as an integer, 2 * sum(pos * (2 * neg_below + neg)) / 2,
    so the result depends neither on summation order nor on the cuts.
    """
    cuts = preds.select(F.percentile_approx(score, [i / AUC_RANGES for i in range(1, AUC_RANGES)], 10_000)).first()[0]
    at = F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]).cast("array<double>")
    g = preds.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    g = g.withColumn("range", F.size(F.filter(at, lambda c: c < F.col("s"))))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("neg_inside", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    # Per range: what its own running sums give, and what every negative of lower ranges adds.
    r = g.groupBy("range").agg(F.sum(F.col("pos") * (2 * F.col("neg_inside") + F.col("neg"))).alias("u2"),
                               F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("neg_below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
    t = r.agg(F.sum(F.col("u2") + 2 * F.col("pos") * F.col("neg_below")).alias("u2"),
              F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return t.select((F.col("u2").cast("double")
                     / (F.lit(2.0) * F.col("positives").cast("double") * F.col("negatives").cast("double")))
                    .alias("auc"), "positives", "negatives")
