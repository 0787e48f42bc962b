"""Expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(number: str | Column, digits: int) -> Column:
    """A double times 10^digits rounded half away from zero and divided again, as C's round does it; zero keeps the sign.

    Spark's ``round`` takes the shortest decimal text of the number for the number itself, so that
    where a mean lies next to a tie the two differ, and turns -1e-9 into 0 where others give -0.
    """
    x = (F.col(number) if isinstance(number, str) else number).cast("double")
    scaled = x * F.lit(10.0**digits)
    whole = F.round(scaled)
    out = F.when(whole == 0, x * F.lit(0.0)).otherwise(whole / F.lit(10.0**digits))
    return F.when(F.abs(scaled) == F.lit(float("inf")), x).otherwise(out)
