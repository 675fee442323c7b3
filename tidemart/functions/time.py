"""Calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_diff(end: Column, start: Column) -> Column:
    """Midnights between two timestamps, negative if ``end`` is earlier."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("long")


def month_start(at: Column) -> Column:
    return F.trunc(F.to_date(at), "month")
