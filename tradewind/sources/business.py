"""A bundle of the business tables, from the adapter or from any source.

Operators take these DataFrames, never paths, so they run the same on the
test-data adapter, on ingested CSV tables or on hand-made fixtures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession



@dataclass
class Biz:
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    translation: DataFrame
    customers: DataFrame
    sellers: DataFrame
    orders_base: DataFrame | None = None

    @property
    def orders_nodates(self) -> DataFrame:
        return self.orders_base if self.orders_base is not None else self.orders


def from_testdata(spark: SparkSession, d: str) -> Biz:
    """Business tables for a test-data folder, from the warehouse load."""
    from tradewind.sources import warehouse
    return warehouse.load(spark, d)
