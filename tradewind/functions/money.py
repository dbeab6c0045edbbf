"""Exact money aggregates.

A double SUM depends on the order rows arrive in, so two engines (or two
runs with different partitioning) disagree in the last bits. Summing in
DECIMAL is exact and order-free; the result is cast back to DOUBLE once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def money_sum(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast(MONEY)).cast("double")


def money_avg(c: Column | str) -> Column:
    """Mean with an exact numerator: sum(decimal) / count(non-null)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(money_sum(c), F.count(c))


def int_avg(c: Column | str) -> Column:
    """Mean of an integer column: exact integer sum / count."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c.cast("bigint")).cast("double"), F.count(c))
