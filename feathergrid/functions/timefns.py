"""Epoch seconds, zones and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 of a timestamp or ISO text, in the session zone (UTC here)."""
    return F.unix_timestamp(c.cast("timestamp"))


def shift_seconds(seconds: Column, by: int) -> Column:
    return seconds + by


def local_to_utc(text: Column, zone: Column, pattern: str = "yyyy-MM-dd HHmm") -> Column:
    """Local text and zone name to UTC; null if it cannot be read, does not exist or exists twice.

    A time skipped by a clock change does not survive the way back.  A time that
    happens twice is also reached from one hour earlier or later in UTC.
    """
    local = F.try_to_timestamp(text, F.lit(pattern))
    utc = F.to_utc_timestamp(local, zone)

    def back(hours: int) -> Column:
        return F.from_utc_timestamp(utc + F.expr(f"interval {hours} hours"), zone)

    clean = (back(0) == local) & (back(1) != local) & (back(-1) != local)
    return F.when(clean, utc)


def on_or_before_years(day: Column, reference: Column, years: int) -> Column:
    """True while a label that needs ``years`` to mature is known at ``reference``."""
    return day <= F.add_months(reference, -12 * years)
