"""Ranking helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, keys, order, name: str = "rank") -> DataFrame:
    """Number rows of a bounded group (candidates of one incident) from 1."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*cols)).cast("long"))
