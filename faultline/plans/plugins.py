"""Plug points: detectors and localizers are functions from DataFrames to a fixed output table.

detectors   (incident_id, metric, k, value) -> (incident_id, k, metric, train, error)
localizers  Telemetry -> (incident_id, source, rank, name, score)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import detect, fusion
from faultline.plans import rankings
from faultline.sources.telemetry import Telemetry

RANKING = ["incident_id", "source", "rank", "name", "score"]


def _squared_z(series: DataFrame, train: str) -> DataFrame:
    return detect.z_errors(series, train).select("incident_id", "k", "metric", "train", "error")


def _ranking(rows: DataFrame, source: str, name: str, score: str) -> DataFrame:
    return rows.select(
        "incident_id", F.lit(source).alias("source"), F.col("rank").cast("long").alias("rank"),
        F.col(name).alias("name"), F.col(score).cast("double").alias("score"),
    )


DETECTORS: dict[str, Callable[[DataFrame, str], DataFrame]] = {"squared_z": _squared_z}

LOCALIZERS: dict[str, Callable[[Telemetry], DataFrame]] = {
    "anchor": lambda t: _ranking(rankings.span_lists(t)[0], "anchor", "service", "longest"),
    "trace": lambda t: _ranking(rankings.span_lists(t)[1], "trace", "service", "errors"),
    "rrf": lambda t: _ranking(fusion.reciprocal_rank_fusion(rankings.four_lists(t)), "rrf", "service", "score"),
    "fusion": lambda t: _ranking(rankings.fused(t), "fusion", "service", "score"),
}


def localize(t: Telemetry, names: list[str]) -> DataFrame:
    """The rankings of several localizers in one table."""
    out = None
    for name in names:
        rows = LOCALIZERS[name](t)
        out = rows if out is None else out.unionByName(rows)
    return out
