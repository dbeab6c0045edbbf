"""Registry of named queries and their SQL oracle texts.

Plan modules register ``key -> fn(spark, sf_dir) -> DataFrame`` and, where
the result is expressible in SQL, the equivalent DuckDB text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that all keys are registered."""
    from tradewind.plans import (  # noqa: F401
        dashboard_plans,
        feature_plans,
        rule_plans,
        alert_plans,
        service_plans,
        ml_plans,
        stream_plans,
        check_plans,
        fitted_plans,
    )
