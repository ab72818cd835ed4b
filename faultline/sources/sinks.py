"""Writers. Incidents and services are partition columns, so readers prune by directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged_days(rows: DataFrame, out: str, time_text: str = "timestamp") -> None:
    """One directory per day, sorted by time inside each file.

    Range partitioning by time spreads a busy day over many files.
    """
    dated = rows.withColumn("date", F.substring(time_text, 1, 10))
    dated.repartitionByRange("date", time_text).sortWithinPartitions("date", time_text).write.mode(
        "overwrite"
    ).partitionBy("date").parquet(out)


def per_incident(rows: DataFrame, out: str, keys: tuple[str, ...] = ("incident_id", "service")) -> None:
    """Partitioned output; dynamic overwrite leaves other incidents alone.

    The content hash in the range key lets a busy incident span several tasks and files.
    """
    spread = rows.repartitionByRange(*keys, F.xxhash64(*rows.columns))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(out)


def wide_sheet(series: DataFrame, out: str, steps: list[int]) -> None:
    """One row per metric and one column per step."""
    wide = series.groupBy("metric").pivot("t", steps).agg(F.first("value"))
    wide.write.mode("overwrite").option("header", True).csv(out)


def report(rows: DataFrame, out: str) -> None:
    """A small final table as JSON lines."""
    rows.write.mode("overwrite").json(out)


def append_rows(rows: DataFrame, out: str) -> None:
    rows.write.mode("append").option("header", True).csv(out)
