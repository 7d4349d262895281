"""Date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_until(ref_date: str, col: Column | str) -> Column:
    """whole days from ``col`` to the constant ``ref_date`` (bigint)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.datediff(F.lit(ref_date).cast("date"), c).cast("bigint")


def day_index(col: Column | str, epoch: str) -> Column:
    """day number relative to ``epoch`` (negative before it)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.datediff(c, F.lit(epoch).cast("date")).cast("bigint")


def minus_months(col: Column | str, months: int) -> Column:
    """F8: calendar months back; the end of month clamps (31 May - 3 = 28/29 Feb)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.add_months(c, -months)
