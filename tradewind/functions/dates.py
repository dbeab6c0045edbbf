"""Date and day-difference rules.

The reference computes "days late" three different ways; each is kept as
its own column function because the results differ for partial days:

* ``floor_days``  - pandas ``(a - b).dt.days``: floor (-1 d 6 h -> -2)
* ``trunc_days``  - SQL ``EXTRACT(DAY FROM a - b)``: toward zero (-> -1)
* ``frac_days``   - SQL ``EXTRACT(EPOCH FROM a - b) / 86400``: fractional
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86400 * 1000 * 1000


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def floor_days(end, start) -> Column:
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return F.floor(micros / F.lit(float(MICROS_PER_DAY)))


def trunc_days(end, start) -> Column:
    return F.timestamp_diff("DAY", _c(start), _c(end))


def frac_days(end, start) -> Column:
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return micros / F.lit(float(MICROS_PER_DAY))


def weekday_mon0(ts) -> Column:
    """pandas ``dt.dayofweek``: Monday = 0 ... Sunday = 6 (training side)."""
    return F.weekday(_c(ts))


def weekday_sun0(ts) -> Column:
    """PostgreSQL ``EXTRACT(DOW ...)``: Sunday = 0 (serving side)."""
    return F.dayofweek(_c(ts)) - 1


def month_label(ts) -> Column:
    """``TO_CHAR(ts, 'YYYY-MM')``."""
    return F.date_format(_c(ts), "yyyy-MM")


def month_label_text(ts) -> Column:
    """``SUBSTRING(ts, 1, 7)`` on the text form of a timestamp."""
    return F.substring(_c(ts).cast("string"), 1, 7)
