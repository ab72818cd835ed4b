"""Typed projections of raw telemetry fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: time patterns, markers and KPI lists
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
LOCAL_ZONE = "Asia/Shanghai"
NO_PARENT = ["", "nan", "0"]
OK_STATUS = ["Ok", "OK", "200"]
SLASH_TIME = r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}"
DASH_TIME = r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}"
CONTAINER_KPIS = [
    "container_cpu_usage_seconds",
    "container_cpu_cfs_throttled_periods",
    "container_cpu_cfs_throttled_seconds",
    "container_memory_usage_MB",
    "container_memory_working_set_MB",
    "container_memory_rss",
    "container_memory_cache",
    "container_memory_failcnt",
    "container_network_receive_MB",
    "container_network_transmit_MB",
    "container_network_receive_errors",
    "container_network_transmit_errors",
    "container_network_receive_packets_dropped",
    "container_network_transmit_packets_dropped",
    "container_fs_usage_MB",
    "container_fs_reads_MB",
    "container_fs_writes_MB",
    "container_fs_io_current",
]
KEY_NODE_KPIS = [
    "system.cpu.iowait",
    "system.cpu.system",
    "system.cpu.user",
    "system.cpu.idle",
    "system.mem.used.percent",
    "system.mem.total",
    "system.mem.used",
    "system.net.bytes_in",
    "system.net.bytes_out",
]
KPI_KEYWORDS = [
    "cpu_total_pct",
    "memory_usage_pct",
    "memory_usage_total",
    "network_in_bytes",
    "network_out_bytes",
]


def parse_time(text: Column) -> Column:
    """Timestamp from text with or without a fraction, null if it cannot be read."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two time texts, null for a bad row."""
    return (F.unix_micros(parse_time(end)) - F.unix_micros(parse_time(start))) / 1000


def parent_id(raw: Column) -> Column:
    return F.when(~raw.isin(NO_PARENT), raw)


def status_code(raw: Column) -> Column:
    text = F.trim(raw.cast("string"))
    return F.when(text.isin(OK_STATUS), 0).otherwise(F.coalesce(text.try_cast("int"), F.lit(0)))


def is_abnormal(raw: Column) -> Column:
    return (status_code(raw) != 0).cast("int")


def container_service(entity: Column) -> Column:
    """Second part of node.pod."""
    return F.get(F.split(entity, r"\."), F.lit(1))


def grpc_service(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def metric_service(metric: Column, known: list[str] | None = None) -> Column:
    """Longest known name the metric starts with, else the text before the first underscore."""
    out = F.substring_index(metric, "_", 1)
    for name in sorted(known or [], key=len):
        out = F.when(F.startswith(metric, F.lit(name)), name).otherwise(out)
    return out


def entity_to_service(entity: Column, level: Column, pods: list[str]) -> Column:
    """pod: itself if known; service: the first pod with that prefix; node: null."""
    first = F.get(
        F.filter(F.array(*map(F.lit, pods)), lambda p: F.startswith(p, entity)), F.lit(0)
    )
    return F.when((level == "pod") & entity.isin(pods), entity).when(level == "service", first)


def minute_label(epoch_s: Column, with_date: bool = False) -> Column:
    """HH-mm, or yyyy-MM-dd_HH-mm, in the fixed local zone."""
    local = F.from_utc_timestamp(F.timestamp_seconds(epoch_s), LOCAL_ZONE)
    return F.date_format(local, "yyyy-MM-dd_HH-mm" if with_date else "HH-mm")


def month_day(epoch_s: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch_s), LOCAL_ZONE), "MMdd")


def directory_prefix(date_label: Column, cluster: Column) -> Column:
    """0320 for cluster-1, 0320b for cluster-2, ...; t behind the date for an unnumbered cluster."""
    number = F.regexp_extract(cluster, r"-(\d+)$", 1).try_cast("int")
    suffix = F.when(number.isNull(), "t").when(number == 1, "").otherwise(F.char(number + 96))
    return F.concat(date_label, suffix)


def dates_to_epoch(text: Column) -> Column:
    """Replace date-times in free text by epoch seconds; slash dates win over dash dates."""

    def swap(pattern: str, fmt: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"({pattern})"))
        return F.aggregate(
            found,
            text,
            lambda acc, d: F.replace(acc, d, F.unix_timestamp(F.try_to_timestamp(d, F.lit(fmt))).cast("string")),
        )

    return (
        F.when(text.rlike(SLASH_TIME), swap(SLASH_TIME, "y/M/d H:m"))
        .when(text.rlike(DASH_TIME), swap(DASH_TIME, "y-M-d H:m"))
        .otherwise(text)
    )


def task_time(text: Column) -> tuple[Column, Column]:
    """MMdd and HH-mm of the first yyyy/MM/dd HH:mm in a request."""
    part = lambda i: F.regexp_extract(text, r"(\d{4})/(\d{2})/(\d{2}) (\d{2}):(\d{2})", i)
    found = text.rlike(r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}")
    return F.when(found, F.concat(part(2), part(3))), F.when(found, F.concat_ws("-", part(4), part(5)))


def has_keyword(kpi: Column, words: list[str] | None = None) -> Column:
    return kpi.rlike("|".join(words or KPI_KEYWORDS))
