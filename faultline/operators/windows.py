"""Joins of telemetry to incident windows and nearest-time lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.scale import interval_join, lookup_join, running_last, series_index

DAY = 86_400

# fixed values: window sizes in seconds and points
FAULT_HALF = 180
NORMAL_HALF = 300
WIDE_HALF = 1_800
WINDOW_POINTS = 30
MIN_BASELINE_POINTS = 5


def spans_in_windows(spans: DataFrame, windows: DataFrame, bucket: int = 2 * WIDE_HALF) -> DataFrame:
    """One row per (incident, span); windows hold win_start and win_end, both inside."""
    return interval_join(spans, windows, "ts", "win_start", "win_end", bucket).drop("win_start", "win_end")


def fault_window_rows(rows: DataFrame, incidents: DataFrame, half: int = FAULT_HALF) -> DataFrame:
    """Rows in [t - half, t + half), cut to the fault's day [0, 86399)."""
    day = F.col("fault_ts") - F.col("fault_ts") % DAY
    windows = incidents.select(
        "incident_id",
        F.greatest(F.col("fault_ts") - half, day).alias("win_start"),
        F.least(F.col("fault_ts") + half, day + DAY - 1).alias("win_end"),
    )
    return interval_join(rows, windows, "ts", "win_start", "win_end", 2 * half, closed=False).drop(
        "win_start", "win_end"
    )


def normal_rows(rows: DataFrame, incidents: DataFrame, half: int = NORMAL_HALF) -> DataFrame:
    """Rows outside [t - half, t + half) of every fault."""
    windows = incidents.select(
        (F.col("fault_ts") - half).alias("win_start"), (F.col("fault_ts") + half).alias("win_end")
    ).distinct()
    return interval_join(
        rows, windows, "ts", "win_start", "win_end", 2 * half, closed=False, how="left_anti"
    )


def window_totals(
    rows: DataFrame, windows: DataFrame, ts: str, sums: dict, bucket: int
) -> DataFrame:
    """Totals per incident for windows that overlap a lot: rows are summed per second first."""
    per_second = rows.groupBy(F.col(ts).alias("_ts")).agg(*[c.alias(n) for n, c in sums.items()])
    joined = interval_join(per_second, windows, "_ts", "win_start", "win_end", bucket)
    return joined.groupBy("incident_id").agg(*[F.sum(n).alias(n) for n in sums])


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    payload: str,
    on: Sequence[str] = (),
    tolerance: int | None = None,
) -> DataFrame:
    """Add the payload of the right row nearest in time and its distance; ties go to the earlier row.

    Distinct times of both sides are merged and the last right row is carried along in both
    directions, so no row is compared with every row of the other side.
    """
    keys = list(on)
    marks = right.groupBy(*keys, F.col(right_ts).alias("_ts")).agg(F.min(payload).alias("_p"))
    probes = left.select(*keys, F.col(left_ts).alias("_ts")).distinct()
    both = marks.withColumn("_side", F.lit(0)).unionByName(
        probes.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    value = F.when(F.col("_side") == 0, F.struct(F.col("_ts").alias("t"), F.col("_p").alias("p")))
    both = both.withColumn("_fwd", F.col("_ts") * 2 + F.col("_side"))
    both = both.withColumn("_bwd", -F.col("_ts") * 2 + F.col("_side"))
    both = running_last(both, keys, "_fwd", value, "_before")
    both = running_last(both, keys, "_bwd", value, "_after")
    db, da = F.col("_ts") - F.col("_before.t"), F.col("_after.t") - F.col("_ts")
    take_before = da.isNull() | (db <= da)
    found = both.filter("_side = 1").select(
        *keys,
        F.col("_ts").alias(left_ts),
        F.when(take_before, F.col("_before.p")).otherwise(F.col("_after.p")).alias(payload),
        F.when(take_before, db).otherwise(da).alias("distance"),
    )
    if tolerance is not None:
        found = found.filter(F.col("distance") <= tolerance)
    return lookup_join(left, found, [*keys, left_ts], "left")


def point_windows(
    points: DataFrame,
    incidents: DataFrame,
    series: Sequence[str],
    size: int = WINDOW_POINTS,
) -> DataFrame:
    """``size`` consecutive points of every series around each fault, numbered k = 0, 1, ...

    Half of them lie before the point nearest to the fault, however far it is (``nearest_pos``, counted
    from 0 in the whole series); at the ends of the data the window is shifted inwards, and a series
    with fewer points is left out. Every series' points are numbered once; windows then pick
    positions by an equi join. Incidents times series is a ``size``-th of the result.
    """
    keys = list(series)
    numbered = series_index(points.dropDuplicates([*keys, "ts"]), keys, "ts", "_pos")
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= size)
    wanted = incidents.select("incident_id", "fault_ts").crossJoin(sizes)
    marks = numbered.select(*keys, "ts", F.col("_pos").alias("nearest_pos"))
    found = nearest_join(wanted, marks, "fault_ts", "ts", "nearest_pos", keys).drop("distance")
    start = F.greatest(F.least(F.col("nearest_pos") - size // 2, F.col("_n") - size), F.lit(0))
    places = found.select(
        "incident_id", "fault_ts", *keys, "nearest_pos", start.alias("_start"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("k"),
    ).withColumn("_pos", F.col("_start") + F.col("k"))
    return numbered.join(places, [*keys, "_pos"]).drop("_pos", "_start")


def baseline(
    points: DataFrame,
    incidents: DataFrame,
    series: Sequence[str],
    start: int,
    end: int,
) -> DataFrame:
    """Mean and sample deviation of each series in [fault - start, fault - end].

    Fewer than five points give (0, 1); a deviation of 0 becomes 1e-6.
    """
    windows = incidents.select(
        "incident_id",
        (F.col("fault_ts") - start).alias("win_start"),
        (F.col("fault_ts") - end).alias("win_end"),
    )
    near = interval_join(points, windows, "ts", "win_start", "win_end", start - end)
    few = F.count("*") < MIN_BASELINE_POINTS
    std = F.stddev_samp("value")
    return near.groupBy("incident_id", *series).agg(
        F.count("*").alias("n"),
        F.when(few, 0.0).otherwise(F.avg("value")).alias("base_mean"),
        F.when(few, 1.0).when(std == 0, 1e-6).otherwise(std).alias("base_std"),
    )
