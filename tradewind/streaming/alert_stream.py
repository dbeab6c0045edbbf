"""The alert feed as a Structured Streaming job.

Source: raw alert text rows arriving as files (Kafka in production; the
operators only need a streaming DataFrame with ``seq, event_time, raw``).
Each micro-batch is parsed with the same column expressions as the batch
path (so stream result = batch result) and appended to the alert table.
A second sink keeps the bounded history: every micro-batch rewrites the
newest-500 store as a new generation, numbered by the epoch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators.alerts import ALERT_COLUMNS, FEED_LIMIT, parse_alerts

RAW_SCHEMA = "seq long, event_time timestamp_ntz, raw string"


def read_alert_stream(spark: SparkSession, in_dir: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(in_dir))


def start_parse_sink(stream: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """Append parsed alerts to a parquet table (exactly-once file sink)."""
    w = (parse_alerts(stream).select(ALERT_COLUMNS).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_bounded_store(stream: DataFrame, store_dir: str, checkpoint: str, keep: int = FEED_LIMIT,
                        available_now: bool = True):
    """Keep only the newest ``keep`` raw alerts (T2), compacted per batch.

    Batch n reads the newest complete generation below n and writes generation n;
    a generation that is complete is never written again, so a retried batch
    finds its own result in place. Only generations that no retry can need are
    deleted, after the new one is complete."""
    spark = stream.sparkSession

    def compact(batch: DataFrame, epoch_id: int) -> None:
        done = complete_generations(spark, store_dir)
        if epoch_id in done:
            return
        before = [g for g in done if g < epoch_id]
        cur = batch.select("seq", "event_time", "raw")
        if before:
            cur = spark.read.parquet(generation_path(store_dir, before[-1])).unionByName(cur)
        (cur.orderBy(F.col("seq").desc_nulls_last()).limit(keep)
            .write.mode("overwrite").parquet(generation_path(store_dir, epoch_id)))
        for g in before[:-1]:
            delete_generation(spark, store_dir, g)

    w = stream.writeStream.foreachBatch(compact).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def generation_path(store_dir: str, generation: int) -> str:
    return f"{store_dir}/gen={generation:012d}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def complete_generations(spark: SparkSession, store_dir: str) -> list[int]:
    """Numbers of the generations whose write has been committed, ascending."""
    fs, p = _fs(spark, store_dir)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[4:]) for n in names if n.startswith("gen=")
                  and fs.exists(_fs(spark, f"{store_dir}/{n}/_SUCCESS")[1]))


def delete_generation(spark: SparkSession, store_dir: str, generation: int) -> None:
    fs, p = _fs(spark, generation_path(store_dir, generation))
    fs.delete(p, True)


def latest_generation(spark: SparkSession, store_dir: str) -> str | None:
    done = complete_generations(spark, store_dir)
    return generation_path(store_dir, done[-1]) if done else None


def read_bounded_store(spark: SparkSession, store_dir: str) -> DataFrame:
    g = latest_generation(spark, store_dir)
    if g is None:
        return spark.createDataFrame([], RAW_SCHEMA)
    return spark.read.parquet(g)
