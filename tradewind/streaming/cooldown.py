"""Per-(entity, action) cooldown as a stream.

A request passes when no passed request of its key lies within ``hours`` of it.
State is the passed requests that can still hold one back: those less than the
cooldown and the allowed lateness older than the newest request seen (the mark).
Older ones expire at the end of a micro-batch, so the state follows the activity
of the last hours, not all keys that ever were.

A micro-batch is a DataFrame job: no worker holds a key's requests.

* Requests that a passed one in the state holds back are found by a join on
  (key, bucket of the cooldown's length). A passed request is put into three
  buckets, and a bucket holds one passed request at most, so the join makes a few
  rows a request; requests of a hot key are spread over its buckets.
* What remains is decided by the batch form (``operators.actions.cooldown``),
  whose windows are those of (key, bucket).

Requests that come late, older than some that passed, are judged like any other:
they pass if no passed request lies within the cooldown before or after them. A
request older than the mark less the lateness is refused, as its neighbours may
have expired; ``late`` counts those in the output. With requests in order the
result is that of the batch form.

Results and state are numbered by micro-batch: a batch reads the newest complete
state below its number, replaces its own result folder, and writes its state
last, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.actions import COOLDOWN_HOURS, cooldown
from tradewind.streaming.alert_stream import complete_generations, delete_generation, generation_path, latest_generation

OUT_SCHEMA = "entity_id string, action string, ts timestamp_ntz, allowed boolean, late boolean"
#: A row for each passed request, and one row without a key for the mark.
STATE_SCHEMA = "entity_id string, action string, us bigint, mark boolean"
LATENESS_HOURS = 24


def _us(col: str) -> F.Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def decide(requests: DataFrame, state: DataFrame, hours: int = COOLDOWN_HOURS,
           lateness: int = LATENESS_HOURS) -> tuple[DataFrame, F.Column]:
    """One micro-batch: ``requests`` with allowed and late; and the new mark as a scalar.
    ``requests`` and ``state`` must be tables that give the same rows when read twice."""
    span = hours * 3_600_000_000
    rows = requests.select(F.col("entity_id").cast("string").alias("entity_id"), F.col("action").cast("string").alias("action"), "ts",
                           _us("ts").alias("us"))
    old_mark = state.where("mark").select(F.max("us")).scalar()
    mark = F.greatest(old_mark, rows.select(F.max("us")).scalar())
    # What came before this micro-batch sets the bound, so the order inside one does not matter.
    rows = rows.withColumn("late", F.coalesce(F.col("us") < old_mark - lateness * 3_600_000_000, F.lit(False)))
    passed = state.where("NOT mark").select(F.col("entity_id").alias("e"), F.col("action").alias("a"), F.col("us").alias("p"),
                                            F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]),
                                                                  lambda k: F.floor(F.col("us") / span) + k)).alias("b"))
    near = ((F.col("entity_id").eqNullSafe(F.col("e"))) & (F.col("action").eqNullSafe(F.col("a")))
            & (F.floor(F.col("us") / span) == F.col("b")) & (F.abs(F.col("us") - F.col("p")) < span))
    open_ = F.col("us").isNotNull() & ~F.col("late")
    free = rows.where(open_).join(passed, near, "left_anti").select("entity_id", "action", "ts")
    held = rows.where(open_).join(passed, near, "left_semi").unionByName(rows.where(~open_))
    out = (cooldown(free, hours=hours).withColumn("late", F.lit(False))
           .unionByName(held.select("entity_id", "action", "ts", F.lit(False).alias("allowed"), "late")))
    return out, mark


def start_cooldown(requests: DataFrame, out_dir: str, state_dir: str, checkpoint: str, hours: int = COOLDOWN_HOURS,
                   lateness: int = LATENESS_HOURS, available_now: bool = True):
    """``requests``: streaming (entity_id, action, ts). Read the results with ``read_results``."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        done = complete_generations(spark, state_dir)
        if epoch_id in done:
            return
        before = [g for g in done if g < epoch_id]
        state = (spark.read.schema(STATE_SCHEMA).parquet(generation_path(state_dir, before[-1])) if before
                 else spark.createDataFrame([], STATE_SCHEMA))
        landed = f"{out_dir}/landed"
        batch.select("entity_id", "action", "ts").write.mode("overwrite").parquet(landed)
        out, mark = decide(spark.read.parquet(landed), state, hours, lateness)
        out.write.mode("overwrite").parquet(generation_path(out_dir, epoch_id))
        results = spark.read.schema(OUT_SCHEMA).parquet(generation_path(out_dir, epoch_id))
        passed = state.where("NOT mark").unionByName(
            results.where("allowed").select("entity_id", "action", _us("ts").alias("us"), F.lit(False).alias("mark")))
        newest = spark.range(1).select(mark.alias("us")).first()[0]
        if newest is not None:
            passed = passed.where(F.col("us") > newest - (hours + lateness) * 3_600_000_000)
        marks = spark.createDataFrame([] if newest is None else [(None, None, newest, True)], STATE_SCHEMA)
        passed.unionByName(marks).write.mode("overwrite").parquet(generation_path(state_dir, epoch_id))
        for g in before[:-1]:
            delete_generation(spark, state_dir, g)

    w = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """All requests judged so far."""
    done = complete_generations(spark, out_dir)
    if not done:
        return spark.createDataFrame([], OUT_SCHEMA)
    return spark.read.schema(OUT_SCHEMA).parquet(*[generation_path(out_dir, g) for g in done])


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The passed requests that can still hold one back."""
    g = latest_generation(spark, state_dir)
    state = spark.read.schema(STATE_SCHEMA).parquet(g) if g else spark.createDataFrame([], STATE_SCHEMA)
    return state.where("NOT mark").drop("mark")
