"""Integer ranges as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def below(count: int | Column) -> Column:
    """The array ``0 .. count-1`` as long integers."""
    last = (F.lit(count) if isinstance(count, int) else count).cast("bigint") - 1
    return F.sequence(F.lit(0).cast("bigint"), last)


def each_below(count: int | Column) -> Column:
    """One row per number of ``below(count)``."""
    return F.explode(below(count))
