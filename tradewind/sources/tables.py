"""Parquet scans of the driver tables.

Scans are lazy; Catalyst prunes columns and pushes filters into the parquet
reader, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per task slot for per-row heavy work.

    A small source read from one or two files yields one or two scan tasks;
    regex or model work on it would leave most cores idle. A round-robin
    repartition fixes that. On large inputs (more splits than slots) this is
    a no-op, so it never adds a shuffle at scale.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
