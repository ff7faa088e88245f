"""Sides of joins whose size is looked at before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of aggregates (topics, categories by day, flags) that may be broadcast.
MAX_ROWS = 200_000


def bounded(df: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
