"""Readers of raw telemetry files. Facts held by file names become columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import projections as pj
from faultline.operators.scale import global_index
from faultline.sources import schemas

# fixed values: file name forms and markers
KPI_FILE = r"kpi_([^/]+?)\.csv"
METRIC_FILE = r"([^/_]+)_([0-9.]+)_([^/]+)_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})\.csv"
SKIP_MESSAGE = "INFO|ERROR"
DONE_PATTERN = r"\[DONE\]\s+(\d{4})\s+(\d{2}-\d{2})"
FILE = "_metadata.file_path"


def _csv(spark: SparkSession, schema: str, path) -> DataFrame:
    return spark.read.schema(schema).options(header=True, mode="PERMISSIVE").csv(path)


def _or_empty(spark: SparkSession, schema: str, path) -> DataFrame:
    """An empty frame with the schema where the path does not exist."""
    try:
        return _csv(spark, schema, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def spans_b(spark: SparkSession, path) -> DataFrame:
    """Span files with epoch-ms times; bad lines become null rows and drop out."""
    raw = _csv(spark, schemas.SPANS_B, path).filter(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull())
    return raw.select(
        "trace_id", "span_id",
        pj.parent_id(F.col("parent_span")).alias("parent_span_id"),
        F.timestamp_millis("timestamp").alias("start_time"),
        F.col("duration").cast("double").alias("duration"),
        F.col("cmdb_id").alias("service_name"),
        "status_code", "operation_name",
        pj.is_abnormal(F.col("status_code")).alias("anomaly"),
    )


def spans_a(spark: SparkSession, path) -> DataFrame:
    """Span files with time texts; the duration comes from start and end, a bad row drops out."""
    raw = _csv(spark, schemas.SPANS_A, path)
    ms = pj.duration_ms(F.col("start_time"), F.col("end_time"))
    return raw.select(
        F.col("timestamp").alias("logged"), "trace_id", "span_id",
        pj.parent_id(F.col("parent_id")).alias("parent_span_id"),
        pj.parse_time(F.col("start_time")).alias("start_time"),
        ms.alias("duration"), "service_name", "status_code",
        F.col("url").alias("operation_name"),
        pj.is_abnormal(F.col("status_code")).alias("anomaly"),
    ).filter(F.col("duration").isNotNull())


def container_metrics(spark: SparkSession, directory: str, keep: list[str] = pj.CONTAINER_KPIS) -> DataFrame:
    """kpi_{name}.csv files of a directory; only the listed KPIs."""
    raw = _csv(spark, schemas.METRIC_CONTAINER, f"{directory}/kpi_*.csv")
    kpi = F.regexp_extract(FILE, KPI_FILE, 1)
    return raw.withColumn("kpi", kpi).filter(F.col("kpi").isin(keep)).select(
        F.col("timestamp").alias("ts"), F.col("cmdb_id").alias("entity"),
        pj.container_service(F.col("cmdb_id")).alias("service"), "kpi", "value",
    )


def service_metrics(spark: SparkSession, path) -> DataFrame:
    """Wide service metrics as rows; empty when the file is absent."""
    raw = _or_empty(spark, schemas.METRIC_SERVICE, path)
    long = raw.unpivot(["service", "timestamp"], ["rr", "sr", "mrt", "count"], "kpi", "value")
    return long.select(
        F.col("timestamp").alias("ts"), F.col("service").alias("entity"),
        pj.grpc_service(F.col("service")).alias("service"), "kpi", "value",
    )


def node_metrics(spark: SparkSession, path, keep: list[str] = pj.KEY_NODE_KPIS) -> DataFrame:
    raw = _or_empty(spark, schemas.METRIC_NODE, path)
    return raw.filter(F.col("kpi_name").isin(keep)).select(
        F.col("timestamp").alias("ts"), F.col("cmdb_id").alias("entity"),
        F.lit(None).cast("string").alias("service"), F.col("kpi_name").alias("kpi"), "value",
    )


def metric_files(spark: SparkSession, directory: str) -> DataFrame:
    """{service}_{ip}_{kpi}_{start}_{end}.csv files; the name's parts become columns."""
    part = lambda i: F.regexp_extract(FILE, METRIC_FILE, i)
    return _csv(spark, schemas.METRIC_A, f"{directory}/*.csv").select(
        "timestamp", "value", part(1).alias("service"), part(2).alias("ip"), part(3).alias("kpi"),
        part(4).alias("start_date"), part(5).alias("end_date"),
    )


def metric_index(files: DataFrame) -> DataFrame:
    """(service, kpi) to its files' date ranges, by end date."""
    ranges = files.select("service", "kpi", "start_date", "end_date").distinct()
    return ranges.groupBy("service", "kpi").agg(
        F.array_sort(F.collect_list(F.struct("end_date", "start_date"))).alias("files")
    )


def metric_sheet(spark: SparkSession, path) -> DataFrame:
    """One row per metric, one column per time: returned as (metric, t, value)."""
    wide = spark.read.option("header", True).csv(path)
    steps = wide.columns[1:]
    number = [int(c) if c.isdigit() else i for i, c in enumerate(steps)]
    cells = [F.struct(F.lit(t).alias("t"), F.col(f"`{c}`").cast("double").alias("value")) for t, c in zip(number, steps, strict=True)]
    cells = F.array(*cells) if cells else F.array().cast("array<struct<t:int,value:double>>")
    return wide.select(F.col(wide.columns[0]).alias("metric"), F.explode(cells).alias("c")).select("metric", "c.t", "c.value")


def logs(spark: SparkSession, directory: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """All log files of a directory, with the time window next to the scan."""
    raw = _csv(spark, schemas.LOG_B, directory)
    if start is not None:
        raw = raw.filter(F.col("timestamp").between(start, end))
    service = F.coalesce(F.get(F.split("cmdb_id", r"\."), F.lit(1)), F.col("cmdb_id"))
    return raw.select(F.col("timestamp").alias("ts"), service.alias("service"), F.col("value").alias("message"))


def ground_truth(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Fault rows from CSV, or from a JSON object of parallel arrays."""
    if fmt == "csv":
        rows = _csv(spark, schemas.TRUTH_ROWS, path)
    else:
        arrays = spark.read.schema(schemas.TRUTH_ARRAYS).json(path, multiLine=True)
        zipped = F.arrays_zip("timestamp", "level", "cmdb_id", "failure_type")
        rows = arrays.select(F.inline(zipped))
    return rows.orderBy("timestamp", "cmdb_id")


def run_table(spark: SparkSession, path) -> DataFrame:
    """Fault injections: messages with INFO or ERROR are skipped, unreadable times drop out."""
    return parse_run_table(_csv(spark, schemas.RUN_TABLE, path))


def parse_run_table(raw: DataFrame) -> DataFrame:
    fault = pj.parse_time(F.trim(F.substring_index("message", ",", 1)))
    return (
        raw.filter(~F.col("message").rlike(SKIP_MESSAGE))
        .select(F.col("datetime").alias("date"), "service", fault.alias("fault_ts"))
        .filter(F.col("fault_ts").isNotNull())
    )


def run_log(spark: SparkSession, path) -> DataFrame:
    """Lines of run logs as (file, pos, line), pos counting in file order over all files.

    A log may be split over several part files and tasks: the order is the path, the split's start
    and the line inside the split.
    """
    lines = spark.read.text(path).select(
        F.col(FILE).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )
    numbered = global_index(lines, ["path", "block", "line_no"], "pos")
    log = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return numbered.select(log.alias("file"), "pos", "line")


def references(spark: SparkSession, path) -> DataFrame:
    """Reference texts per case and expert."""
    raw = spark.read.schema(schemas.REFERENCE).json(path, multiLine=True)
    return raw.select("case_id", "date", "time", F.explode("references").alias("expert", "text"))


def finished_keys(spark: SparkSession, path) -> DataFrame:
    """Keys of finished incidents in a run log."""
    lines = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", DONE_PATTERN, i)
    return lines.filter(F.col("value").rlike(DONE_PATTERN)).select(part(1).alias("date"), part(2).alias("time")).distinct()


def remaining(incidents: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Incidents without output yet."""
    return incidents.join(done.select(*keys).distinct(), keys, "left_anti")


def truth_by_minute(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Truth per key; later rows overwrite earlier ones."""
    return rows.groupBy(*keys).agg(F.max_by("service", seq).alias("service"))


def fault_dates(incidents: DataFrame) -> DataFrame:
    return incidents.select("date").distinct().orderBy("date")
