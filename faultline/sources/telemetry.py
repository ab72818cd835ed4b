"""Telemetry views derived from the given tables.

spans      one row per (trace, span): line items of an order are its spans, reports of the same
           line number are merged; line n hangs under line n / 2, so that missing parents, traces
           without a root and single-span traces all occur
metrics    6-hour averages of the events, one series per (service, kpi)
incidents  the first error event of each service on each day
logs       one line per event
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.scale import interval_join, spread

# fixed values of the telemetry rules, the same in the SQL views
EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC
SPAN_RANGE = 2_592_000  # 30 days
METRIC_STEP = 21_600  # 6 hours
WIDE_WINDOW = 1_800  # seconds on both sides of a fault
LOCAL_WINDOW = 180
SPAN_SERVICES = 10
METRIC_SERVICES = 3


class Telemetry:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def span_reports(self) -> int:
        return self.table("lineitem").count()

    @cached_property
    def spans(self) -> DataFrame:
        key = F.col("trace_id")
        reports = self.table("lineitem").select(
            F.col("l_orderkey").alias("trace_id"),
            F.col("l_linenumber").cast("long").alias("span_id"),
            F.col("l_suppkey").alias("_supp"),
            F.col("l_extendedprice").alias("_price"),
            (F.col("l_returnflag") == "R").cast("int").alias("_failed"),
        )
        # dealt out before they are merged: hardly any reports merge inside a file split, and tasks hold a fixed
        # number of reports however large the table and its splits are
        return (
            spread(reports, self.span_reports, ["trace_id", "span_id"])
            .groupBy("trace_id", "span_id")
            .agg(
                F.min("_supp").alias("_supp"),
                (F.max("_price") / 100).alias("duration"),
                F.max("_failed").cast("long").alias("status"),
            )
            .select(
                "trace_id",
                "span_id",
                F.when(F.col("span_id") > 1, F.floor(F.col("span_id") / 2)).alias("parent_span_id"),
                F.concat(F.lit("svc"), F.col("_supp") % SPAN_SERVICES).alias("service"),
                "duration",
                "status",
                (F.lit(EPOCH) + key * 7919 % SPAN_RANGE + F.col("span_id") - 1).alias("ts"),
            )
        )

    @cached_property
    def events(self) -> DataFrame:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            "event_id",
            us.alias("us"),
            F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("ts"),
            "user_id",
            "event_type",
            "value",
            "props",
            F.concat(F.lit("svc"), F.col("user_id") % SPAN_SERVICES).alias("service"),
        )

    @cached_property
    def incidents(self) -> DataFrame:
        first = F.min(F.struct("us", "event_id", "value"))
        return (
            self.events.filter(F.col("event_type") == "error")
            .groupBy("service", F.expr("ts div 86400").alias("day"))
            .agg(first.alias("f"))
            .select(
                F.col("f.event_id").alias("incident_id"),
                F.expr("f.us div 1000000").alias("fault_ts"),
                "service",
                "day",
                F.when(F.col("f.value") < 10, "latency")
                .when(F.col("f.value") < 20, "error")
                .otherwise("resource")
                .alias("failure_type"),
                F.element_at(
                    F.array(F.lit("pod"), F.lit("service"), F.lit("node")),
                    (F.col("f.event_id") % 3 + 1).cast("int"),
                ).alias("level"),
            )
        )

    @cached_property
    def metrics(self) -> DataFrame:
        cents = F.round(F.col("value") * 100).cast("long")
        return (
            self.events.groupBy(
                F.concat(F.lit("svc"), F.col("user_id") % METRIC_SERVICES).alias("service"),
                F.col("event_type").alias("kpi"),
                F.expr(f"(ts - {EPOCH}) div {METRIC_STEP}").alias("t"),
            )
            .agg((F.sum(cents) / (F.lit(100.0) * F.count("*"))).alias("value"))
            .withColumn("metric", F.concat_ws("_", "service", "kpi"))
        )

    @cached_property
    def logs(self) -> DataFrame:
        level = (
            F.when(F.col("event_type") == "error", "ERROR")
            .when(F.col("event_type") == "view", "WARN")
            .otherwise("INFO")
        )
        return self.events.select(
            "event_id",
            "ts",
            "service",
            F.concat_ws(
                " ",
                level,
                F.col("event_type"),
                F.when(F.col("event_type") == "signup", F.concat(F.lit("trace_id="), F.col("user_id"))),
                F.col("props"),
            ).alias("message"),
        )

    @cached_property
    def fault_windows(self) -> DataFrame:
        """Incidents with the bounds of their wide window, closed on both sides."""
        return self.incidents.select(
            "incident_id",
            "fault_ts",
            F.col("service").alias("fault_service"),
            (F.col("fault_ts") - WIDE_WINDOW).alias("win_start"),
            (F.col("fault_ts") + WIDE_WINDOW).alias("win_end"),
        )

    @cached_property
    def window_spans(self) -> DataFrame:
        """Spans inside each incident's wide window, one row per (incident, span)."""
        return interval_join(
            self.spans, self.fault_windows, "ts", "win_start", "win_end", bucket=2 * WIDE_WINDOW
        ).drop("win_start", "win_end")
