"""Structured Streaming forms of the windowed and stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultline.operators.detect import LEVEL_DRIFT, TAIL_Q, _Tail
from faultline.session import run_dir

# fixed values
SAMPLING = "30 seconds"
BASELINE = "10 minutes"
TRACE_GAP = "10 seconds"
FAULT_SECONDS = 180

STATE_SCHEMA = (
    "n long, nt long, s1 double, s2 double, level double, bound double, recent array<double>, head array<double>"
)


def bucketed(points: DataFrame, delay: str, width: str = SAMPLING) -> DataFrame:
    """Tumbling averages per (service, kpi); points later than the watermark are dropped."""
    return (
        points.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "service", "kpi")
        .agg(F.avg("value").alias("value"), F.count("*").alias("n"))
        .select(F.col("window.start").alias("ts"), "service", "kpi", "value", "n")
    )


def moving_baseline(points: DataFrame, delay: str, width: str = BASELINE, step: str = SAMPLING) -> DataFrame:
    """Mean and sample deviation over a sliding window per (service, kpi)."""
    return (
        points.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, step), "service", "kpi")
        .agg(F.count("*").alias("n"), F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std"))
        .select(F.col("window.end").alias("ts"), "service", "kpi", "n", "base_mean", "base_std")
    )


def assembled_traces(spans: DataFrame, delay: str, gap: str = TRACE_GAP) -> DataFrame:
    """A trace is complete when no span arrived for ``gap``."""
    return (
        spans.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), "trace_id")
        .agg(F.count("*").alias("span_count"), F.max("status").alias("status"))
        .select("trace_id", "span_count", "status", F.col("session_window.start").alias("start_ts"))
    )


def fault_slots(spans: DataFrame, faults: DataFrame, delay: str, half: int = FAULT_SECONDS) -> DataFrame:
    """(service, slot, fault_ts): faults in every slot of ``2 * half`` seconds within their reach that holds spans of
    their service.

    Both streams are reduced to distinct slots and moments before they meet, so neither the state nor what is
    written grows with the pairs of spans and faults. The slots carry the watermarks, which lets Spark drop old
    state. ``span_faults`` lists the pairs.
    """
    late = f"{delay} {2 * half} seconds"  # a slot begins up to its width before its rows
    left = spans.select("service", slot(F.unix_seconds("ts"), half).alias("slot")).withWatermark("slot", late)
    right = with_slots(faults.select(F.col("service").alias("fault_service"), "fault_ts"), half, "fault_slot")
    right = right.withWatermark("fault_slot", late).dropDuplicates(["fault_service", "fault_slot", "fault_ts"])
    same = (F.col("service") == F.col("fault_service")) & (F.col("slot") == F.col("fault_slot"))
    return left.dropDuplicates(["service", "slot"]).join(right, same).select("service", "slot", "fault_ts")


def slot(seconds: Column, half: int) -> Column:
    """The start of the slot that a time lies in."""
    return F.timestamp_seconds(F.floor(seconds / (2 * half)) * (2 * half))


def with_slots(faults: DataFrame, half: int, name: str) -> DataFrame:
    """One row per fault and slot that times within ``half`` seconds of it lie in."""
    width, at = 2 * half, F.unix_seconds("fault_ts")
    starts = F.sequence(F.floor((at - half) / width), F.floor((at + half) / width))
    return faults.withColumn(name, F.explode(starts)).withColumn(name, F.timestamp_seconds(F.col(name) * width))


def span_faults(spans: DataFrame, faults: DataFrame, slots: DataFrame, half: int = FAULT_SECONDS) -> DataFrame:
    """(event_id, trace_id, span_id, n): all reports of a span with all faults of its service in ``slots`` that are
    within ``half`` seconds.

    Reports are merged before they meet faults. An event id that stands in one row gives every span once, so
    these pairs go to the reader as they come; only those of repeated ids are merged by a shuffle.
    """
    reports = spans.groupBy("trace_id", "span_id", "service", "ts").agg(F.count("*").alias("n"))
    reports = reports.withColumn("slot", slot(F.unix_seconds("ts"), half))
    times = faults.groupBy("event_id").agg(F.count("*").alias("times"))
    repeated = not times.filter("times > 1").isEmpty()
    if repeated:
        times = times.withColumnRenamed("event_id", "_id")
        faults = faults.join(times, F.col("event_id").eqNullSafe(F.col("_id"))).drop("_id")
    reach = F.expr(f"INTERVAL {half} SECONDS")
    near = (F.col("ts") >= F.col("fault_ts") - reach) & (F.col("ts") < F.col("fault_ts") + reach)
    pairs = reports.join(faults.join(slots, ["service", "fault_ts"]), ["service", "slot"]).filter(near)
    keys = ["event_id", "trace_id", "span_id"]
    if not repeated:
        return pairs.select(*keys, "n")
    merged = pairs.filter("times > 1").groupBy(*keys).agg(F.sum("n").alias("n"))
    return pairs.filter("times = 1").select(*keys, "n").union(merged)


def rolling_accuracy(cases: DataFrame, delay: str, width: str = "1 day") -> DataFrame:
    """Cases and top-1 accuracy per window."""
    return (
        cases.withWatermark("ts", delay)
        .groupBy(F.window("ts", width))
        .agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("ac1"))
        .select(F.col("window.start").alias("ts"), "n", "ac1")
    )


def live_thresholds(
    buckets: DataFrame, calibrate: int = 30, depth: int = 10, q: float = TAIL_Q
) -> DataFrame:
    """Drift-corrected tail thresholds, updated per arriving bucket.

    The state of a series is a handful of sums and its last ``depth`` values. Input is bucketed, so
    a series brings at most one row per bucket however many raw points it has.
    """
    out_schema = "service string, kpi string, ts timestamp, value double, threshold double, alarm boolean"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames).sort_values("ts")
        n, nt, s1, s2, level, bound, recent, head = (
            state.get if state.exists else (0, 0, 0.0, 0.0, 0.0, 0.0, [], [])
        )
        recent, head = list(recent), list(head)
        tail = None
        if nt > 0:
            tail = _Tail.restored(n, nt, s1, s2, level, bound, q)
        out = []
        for ts, value in zip(rows["ts"], rows["value"]):
            if tail is None:
                head.append(float(value))
                if len(head) == calibrate:
                    x = np.array(head)
                    means = np.convolve(x, np.ones(depth) / depth, "valid")[:-1]
                    tail = _Tail(x[depth:] - means, LEVEL_DRIFT, q)
                    recent, head = [float(v) for v in x[-depth:]], []
                continue
            base = sum(recent) / len(recent)
            limit = float(tail.limit + base)
            alarm = bool(tail.see(value - base))
            if not alarm:
                recent = recent[1:] + [float(value)]
            out.append((*key, ts, float(value), limit, alarm))
        if tail is not None:
            n, nt = tail.n, tail.nt
            s1, s2, level, bound = (float(x) for x in (tail.s1, tail.s2, tail.level, tail.limit))
        state.update((n, nt, s1, s2, level, bound, recent, head))
        yield pd.DataFrame(out, columns=["service", "kpi", "ts", "value", "threshold", "alarm"])

    return buckets.groupBy("service", "kpi").applyInPandasWithState(
        step, out_schema, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> str:
    """Process all available input into a Parquet folder and return it.

    Output and checkpoint lie in the shared folder, so a restarted query goes on exactly once.
    """
    out = run_dir(stream.sparkSession, label)
    writer = stream.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    started = writer.option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(
        availableNow=True
    ).start()
    started.awaitTermination()
    return f"{out}/data"
