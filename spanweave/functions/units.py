"""Time is a BIGINT of microseconds; thresholds are given in units (a second of media time, or any other length) and made integers once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The unit of the event carrier: six hours play the part of one second.
UNIT = 21_600_000_000


def us(x: float, unit: int = UNIT) -> int:
    """``x`` units in microseconds."""
    return round(x * unit)


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def days(ts: str) -> Column:
    return F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")).cast("long")
