"""Joins with a table whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup table up to which it is broadcast.
MAX_BROADCAST_ROWS = 200_000


def lookup(df: DataFrame, table: DataFrame, on: Column, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left join; broadcast only if the table has ``most`` rows at most, else shuffled."""
    if table.limit(most + 1).count() <= most:
        table = F.broadcast(table)
    return df.join(table, on, "left")
