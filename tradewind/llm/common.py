"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, read lazily; the path is only given to Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tradewind/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back. A later
    stage that loses an executor re-reads files instead of running ``df`` again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[dict], ddl: str) -> DataFrame:
    """A driver-made table of a size fixed by parameters, as a JVM-side expression."""
    return (spark.range(1)
            .select(F.explode(F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{ddl}>>")).alias("r"))
            .select("r.*"))


def ascii_lower(col) -> F.Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
