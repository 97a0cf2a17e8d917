"""Interaction totals and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates of totals below 2^26 differ by more than 2^-53, so these whole numbers keep their order.
_STEPS = float(1 << 53)


def total_interaction() -> Column:
    """likes + comments + shares; NULL if one of them is NULL."""
    return sum((F.col(c).cast("bigint") for c in ("comments", "shares")), F.col("likes").cast("bigint"))


def share_conversion() -> Column:
    """shares / total interaction, 0.0 where there was no interaction."""
    total = total_interaction()
    return F.when(total > 0, F.col("shares") / total).otherwise(F.lit(0.0))


def as_number(rate: Column) -> Column:
    """A rate between 0 and 1 as a whole number in the same order."""
    return F.floor(rate * F.lit(_STEPS)).cast("bigint")
