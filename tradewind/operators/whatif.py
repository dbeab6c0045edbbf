"""What-if search over whole order books.

The reference loops over (weight, weekday) options for one order and calls
the model once per option. Here every open order's option grid is exploded
into rows (bounded per order: 7 weekdays x ceil(weight / 0.5) parcel sizes),
scored by the cell it falls into (the trees see bins, and a cell goes through
them once) and reduced per order with ``min(struct)``. The grid never leaves
its order's partition until the per-order reduction.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators import ml as ML

STEP_KG = 0.5
START_KG = 0.1
BULKY_KG = 15.0
DEFAULT_KG = 1.5
DAYS = 7


def weight_grid(kg: F.Column) -> F.Column:
    """``numpy.arange(0.1, kg + 0.1, 0.5)`` (same float length rule), or the
    weight alone for bulky goods that cannot be split."""
    n = F.ceil(((kg + F.lit(START_KG)) - F.lit(START_KG)) / F.lit(STEP_KG))
    split = F.when(n >= 1, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")),
                                       lambda k: F.lit(START_KG) + k.cast("double") * F.lit(STEP_KG))) \
             .otherwise(F.array().cast("array<double>"))
    return F.when(kg >= BULKY_KG, F.array(kg)).otherwise(split)


def _base_inputs(model: PipelineModel, feats: DataFrame) -> DataFrame:
    kg = F.coalesce(F.col("product_weight_g") / F.lit(1000.0), F.lit(DEFAULT_KG))
    return feats.select("order_id", "payment_type", "order_value", "day_of_week",
                        kg.alias("weight_kg")).withColumn("payment_type", ML.known_payment(model))


def best_scenarios(model: PipelineModel, feats: DataFrame) -> DataFrame:
    """Per open order: baseline risk and the lowest-risk (weight, day) option
    strictly below it; ties go to the first option in grid order.

    The baseline is one more row of the order's option set, so a single
    scoring covers everything and one per-order aggregate picks both
    the baseline and the best option (no join back to the inputs).
    """
    base = _base_inputs(model, feats)
    opt = lambda is_base, widx, kg, day: F.struct(
        F.lit(is_base).alias("is_base"), widx.cast("int").alias("widx"), kg.alias("kg"),
        day.cast("int").alias("day"))
    grid = F.transform(weight_grid(F.col("weight_kg")), lambda kg, i: F.struct(i.alias("i"), kg.alias("kg")))
    days = F.sequence(F.lit(0), F.lit(DAYS - 1))
    options = F.concat(
        F.array(opt(True, F.lit(-1), F.col("weight_kg"), F.col("day_of_week"))),
        F.flatten(F.transform(grid, lambda g: F.transform(days, lambda dd: opt(False, g["i"], g["kg"], dd)))))
    rows = base.select("order_id", "payment_type", "order_value", "weight_kg",
                       F.col("day_of_week").alias("base_day"), F.explode(options).alias("o"))
    scored = ML.score_by_cell(model, rows.select("order_id", "payment_type", "order_value", "weight_kg", "base_day", "o",
                                         (F.col("o.kg") * 1000.0).alias("product_weight_g"),
                                         F.col("o.day").alias("day_of_week")))
    risk = F.col("p1") * 100.0
    agg = scored.groupBy("order_id").agg(
        F.max(F.when(F.col("o.is_base"), risk)).alias("base_risk"),
        F.min(F.when(~F.col("o.is_base"), F.struct(risk.alias("risk"), F.col("o.widx").alias("widx"),
                                                    F.col("o.day").alias("day"), F.col("o.kg").alias("kg"))))
        .alias("b"),
        F.first("weight_kg").alias("weight_kg"), F.first("base_day").alias("day_of_week"))
    better = F.coalesce(F.col("b.risk") < F.col("base_risk"), F.lit(False))
    return agg.select("order_id", "base_risk",
                      F.when(better, F.col("b.risk")).otherwise(F.col("base_risk")).alias("best_risk"),
                      F.when(better, F.col("b.kg")).otherwise(F.col("weight_kg")).alias("best_weight_kg"),
                      F.when(better, F.col("b.day")).otherwise(F.col("day_of_week")).alias("best_day"),
                      better.alias("improved"),
                      (F.col("weight_kg") >= BULKY_KG).alias("unbreakable"))


# Fixed scenario set for the one-change simulation (our choice).
SCENARIOS = [("halve_weight", 0.5, None), ("ship_monday", 1.0, 0), ("halve_weight_monday", 0.5, 0)]


BASELINE = "baseline"


def scenario_rows(model: PipelineModel, feats: DataFrame) -> DataFrame:
    """A row for each order and scenario, and one for the order as it is."""
    base = _base_inputs(model, feats)
    sc = F.array(F.struct(F.lit(BASELINE).alias("scenario"), F.lit(1.0).alias("factor"),
                          F.lit(None).cast("int").alias("day")),
                 *[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("factor"),
                            F.lit(d).cast("int").alias("day")) for n, f, d in SCENARIOS])
    rows = base.select("*", F.explode(sc).alias("s"))
    return rows.select(
        "order_id", "payment_type", "order_value", F.col("s.scenario").alias("scenario"),
        (F.col("weight_kg") * F.col("s.factor") * 1000.0).alias("product_weight_g"),
        F.coalesce(F.col("s.day"), F.col("day_of_week")).alias("day_of_week"))


def scenario_deltas(model: PipelineModel, feats: DataFrame) -> DataFrame:
    """New risk minus baseline for each order and scenario. The baseline is
    one more literal scenario row (factor 1, own day), so one scoring
    covers all rows; a per-order window over the order's 1 + len(SCENARIOS)
    rows supplies the baseline to each scenario row (no join)."""
    from pyspark.sql import Window
    sim = ML.score_by_cell(model, scenario_rows(model, feats))
    risk = sim.select("order_id", "scenario", (F.col("p1") * 100.0).alias("sim_risk"))
    w = Window.partitionBy("order_id")
    with_base = risk.withColumn("base_risk", F.max(F.when(F.col("scenario") == BASELINE,
                                                          F.col("sim_risk"))).over(w))
    return (with_base.where(F.col("scenario") != BASELINE)
                     .withColumn("risk_diff", F.col("sim_risk") - F.col("base_risk")))
