"""Joins against small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; the engine decides beyond.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows, which is checked."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
