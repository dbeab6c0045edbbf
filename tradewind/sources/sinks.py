"""Table sinks: full replace, append, and the bounded alert store.

Paths live under the shared checkpoint folder (``scratch_dir``) or any
location the caller names; writes are plain parquet so a lost executor only
re-runs its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_and_trim(spark: SparkSession, path: str, existing: DataFrame, new: DataFrame,
                    keep: int, order_col: str = "seq") -> DataFrame:
    """Write ``existing``, append ``new``, then compact the store to its newest
    ``keep`` rows (a new generation folder; readers switch after the write). ``new`` takes
    the store's types: one folder never holds two. Each call copies the store; a feed that
    grows is kept by ``feed_log``."""
    new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in existing.schema])
    write_table(existing, f"{path}/gen0", "overwrite")
    write_table(new, f"{path}/gen0", "append")
    store = spark.read.parquet(f"{path}/gen0")
    write_table(store.orderBy(F.col(order_col).desc_nulls_last()).limit(keep), f"{path}/gen1", "overwrite")
    return spark.read.parquet(f"{path}/gen1")


def truncate_table(spark: SparkSession, path: str, schema: str) -> None:
    """Reset a store (the reference's "clear feed" button): replace the
    table at ``path`` with an empty one of the same schema. Scoped to that
    table only, never the whole store."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
