"""Queries that write raw files from the given tables and read them back with the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.numbers import r6
from faultline.operators import logs as lg
from faultline.plans.events import LINES, raw_spans, run_lines
from faultline.plans.registry import query
from faultline.session import run_dir
from faultline.sources import readers, sinks
from faultline.sources.telemetry import Telemetry

KPIS = ["click", "error", "purchase", "signup", "view"]


def csv_out(df, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


@query(
    "s1_span_files",
    """SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(span_id AS VARCHAR) AS span_id, CAST(parent_span_id AS VARCHAR) AS parent_span_id, ts AS start_s, floor(duration) AS duration,
  service AS service_name, CAST(status AS INTEGER) AS anomaly FROM spans""",
)
def s1(t: Telemetry):
    raw = t.spans.select(
        (F.col("ts") * 1000).alias("timestamp"), F.col("service").alias("cmdb_id"), "span_id", "trace_id",
        F.floor("duration").alias("duration"), F.lit("rpc").alias("type"),
        F.when(F.col("status") == 1, "500").otherwise("Ok").alias("status_code"),
        F.concat(F.lit("/"), "service").alias("operation_name"),
        F.coalesce(F.col("parent_span_id").cast("string"), F.lit("0")).alias("parent_span"),
    )
    got = readers.spans_b(t.spark, csv_out(raw, run_dir(t.spark, "spans-b")))
    return got.select(
        "trace_id", "span_id", "parent_span_id", F.unix_seconds("start_time").alias("start_s"),
        "duration", "service_name", "anomaly",
    )


@query(
    "s1_span_files_text_times",
    "SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(span_id AS VARCHAR) AS span_id, CAST(status AS INTEGER) AS anomaly, ts AS start_s FROM spans WHERE span_id <> 7",
)
def s1_a(t):
    raw = raw_spans(t).select(
        F.col("start_time").alias("timestamp"), F.lit("h").alias("host_ip"), F.col("service").alias("service_name"),
        "trace_id", "span_id", "parent_id", "start_time", "end_time", F.lit("/u").alias("url"), "status_code",
        F.lit("m").alias("message"),
    )
    got = readers.spans_a(t.spark, csv_out(raw, run_dir(t.spark, "spans-a")))
    return got.select("trace_id", "span_id", "anomaly", F.unix_seconds("start_time").alias("start_s"))


@query(
    "s2_container_metric_files",
    "SELECT kpi, service, count(*) AS n, round(sum(value), 6) AS total FROM metrics WHERE kpi IN ('click', 'error', 'view') GROUP BY ALL",
)
def s2(t):
    root = run_dir(t.spark, "kpi")
    entity = F.concat(F.lit("node-1."), "service")
    for kpi in KPIS:
        rows = t.metrics.filter(F.col("kpi") == kpi).select(F.col("t").alias("timestamp"), entity.alias("cmdb_id"), "value")
        csv_out(rows, f"{root}/kpi_{kpi}.csv")
    got = readers.container_metrics(t.spark, root, keep=["click", "error", "view"])
    return got.groupBy("kpi", "service").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@query(
    "s3_service_and_node_metrics",
    """SELECT 'service' AS origin, kpi, count(*) AS n FROM (SELECT unnest(['rr', 'sr', 'mrt', 'count']) AS kpi FROM metrics) GROUP BY kpi
UNION ALL SELECT 'node', 'system.cpu.user', count(*) FROM metrics WHERE kpi = 'view'""",
)
def s3(t):
    root = run_dir(t.spark, "svc")
    wide = t.metrics.select(
        F.concat("service", F.lit("-grpc")).alias("service"), F.col("t").alias("timestamp"),
        F.col("value").alias("rr"), F.col("value").alias("sr"), F.col("value").alias("mrt"), F.col("value").alias("count"),
    )
    name = F.when(F.col("kpi") == "view", "system.cpu.user").otherwise("other")
    nodes = t.metrics.select(F.col("t").alias("timestamp"), F.col("service").alias("cmdb_id"), name.alias("kpi_name"), "value")
    service = readers.service_metrics(t.spark, csv_out(wide, f"{root}/service"))
    node = readers.node_metrics(t.spark, csv_out(nodes, f"{root}/node"))
    absent = readers.node_metrics(t.spark, f"{root}/absent")
    both = service.withColumn("origin", F.lit("service")).unionByName(
        node.unionByName(absent).withColumn("origin", F.lit("node"))
    )
    return both.groupBy("origin", "kpi").agg(F.count("*").alias("n"))


@query(
    "s4_s5_log_files",
    """SELECT service, count(*) AS n, min(ts) AS first_ts FROM logs WHERE ts BETWEEN 1704067200 AND 1705276800 GROUP BY service""",
)
def s4(t):
    raw = t.logs.select(F.col("ts").alias("timestamp"), F.concat(F.lit("node-1."), "service").alias("cmdb_id"), F.col("message").alias("value"))
    path = csv_out(raw, run_dir(t.spark, "logs"))
    got = readers.logs(t.spark, path, 1_704_067_200, 1_705_276_800)
    return got.groupBy("service").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


TRUTH_SQL = "SELECT fault_ts AS timestamp, level, service AS cmdb_id, failure_type FROM incidents"


def truth_frame(t):
    return t.incidents.select(F.col("fault_ts").alias("timestamp"), "level", F.col("service").alias("cmdb_id"), "failure_type")


@query("s6_ground_truth_rows", TRUTH_SQL)
def s6_csv(t):
    return readers.ground_truth(t.spark, csv_out(truth_frame(t), run_dir(t.spark, "truth")))


@query("s6_ground_truth_arrays", TRUTH_SQL)
def s6_json(t):
    # one object of parallel arrays per day, the way the files hold them
    day = F.expr("timestamp div 86400")
    cells = F.array_sort(F.collect_list(F.struct("timestamp", "level", "cmdb_id", "failure_type")))
    arrays = truth_frame(t).groupBy(day.alias("day")).agg(cells.alias("c"))
    fields = [F.col(f"c.{n}").alias(n) for n in ("timestamp", "level", "cmdb_id", "failure_type")]
    path = run_dir(t.spark, "truth-json")
    arrays.select(*fields).write.json(path)
    rows = t.spark.read.schema(readers.schemas.TRUTH_ARRAYS).json(path)
    zipped = F.arrays_zip("timestamp", "level", "cmdb_id", "failure_type")
    return rows.select(F.inline(zipped))


@query(
    "s7_merge_spans_by_day",
    "SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, count(*) AS n, count(DISTINCT trace_id) AS traces FROM spans GROUP BY 1",
)
def s7(t):
    stamped = t.spans.withColumn("timestamp", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss"))
    out = run_dir(t.spark, "days")
    sinks.merged_days(stamped, out)
    got = t.spark.read.parquet(out)
    pairs = got.groupBy("date", "trace_id").agg(F.count("*").alias("c"))
    return pairs.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.sum("c").alias("n"), F.count("*").alias("traces")
    )


@query("s8_s15_metric_sheet", "SELECT metric, CAST(t AS INTEGER) AS t, value FROM metrics")
def s8(t):
    # times are the columns of the sheet: at most one per 6-hour step of the kept period
    steps = [r["t"] for r in t.metrics.select("t").distinct().orderBy("t").collect()]
    out = run_dir(t.spark, "sheet")
    sinks.wide_sheet(t.metrics, out, steps)
    got = readers.metric_sheet(t.spark, out)
    return got.withColumn("t", (F.col("t") + steps[0]).cast("int")).filter("value is not null")


@query(
    "s9_metric_file_index",
    "SELECT DISTINCT service, kpi, '2024-01-01' AS start_date, '2024-01-31' AS end_date FROM metrics",
)
def s9(t):
    root = run_dir(t.spark, "files")
    for kpi in KPIS:
        for i in range(3):
            rows = t.metrics.filter((F.col("kpi") == kpi) & (F.col("service") == f"svc{i}")).select(F.col("t").alias("timestamp"), "value")
            csv_out(rows, f"{root}/svc{i}_0.0.0.{i}_{kpi}_2024-01-01_2024-01-31.csv")
    index = readers.metric_index(readers.metric_files(t.spark, root))
    return index.select("service", "kpi", F.inline("files")).select("service", "kpi", "start_date", "end_date")


RUN_SQL = """
rt AS (SELECT event_id, us, ts, service, strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date FROM ev WHERE event_type IN ('error', 'view'))
"""


def run_messages(t):
    at = F.timestamp_micros("us")
    stamp = F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    kind = F.col("event_type")
    message = (
        F.when(kind == "signup", F.concat(stamp, F.lit(", INFO restart")))
        .when(kind == "click", F.concat(stamp, F.lit(" | ERROR, x")))
        .when(kind == "purchase", "no time, at all")
        .otherwise(F.concat(stamp, F.lit(", fault injected, cpu")))
    )
    return t.events.select(F.date_format(at, "yyyy-MM-dd").alias("datetime"), "service", message.alias("message"))


@query("s11_run_table", RUN_SQL + "SELECT date, service, us AS fault_us FROM rt")
def s11(t):
    path = csv_out(run_messages(t), run_dir(t.spark, "runs"))
    return readers.run_table(t.spark, path).select("date", "service", F.unix_micros("fault_ts").alias("fault_us"))


@query("s19_fault_dates", RUN_SQL + "SELECT DISTINCT date FROM rt")
def s19(t):
    return readers.fault_dates(readers.parse_run_table(run_messages(t)))


@query(
    "s12_run_log_files",
    LINES + "SELECT file, count(*) AS n_lines, count(DISTINCT case_pos) AS n_cases, count(*) FILTER (event_type = 'error' AND case_pos IS NOT NULL) AS n_localized FROM cs WHERE case_pos IS NOT NULL GROUP BY file",
)
def s12(t):
    out = run_dir(t.spark, "runlog")
    run_lines(t).repartitionByRange("file", "pos").sortWithinPartitions("file", "pos").select("file", "line").write.partitionBy("file").text(out)
    lines = readers.run_log(t.spark, out).withColumn("file", F.regexp_replace("file", "^file=", ""))
    cases = lg.segment_cases(lg.with_records(lines), F.col("record.type") == "task_parsed")
    return cases.groupBy("file").agg(
        F.count("*").alias("n_lines"), F.count_distinct("case_pos").alias("n_cases"),
        F.count_if(F.col("record.type") == "localization").alias("n_localized"),
    )


@query(
    "s13_truth_by_minute",
    "SELECT ts // 86400 AS day, ts // 60 % 1440 AS minute, arg_max(service, {'a': us, 'b': event_id}) AS service FROM ev WHERE event_type = 'error' GROUP BY ALL",
)
def s13(t):
    rows = t.events.filter("event_type = 'error'").select(
        F.expr("ts div 86400").alias("day"), F.expr("ts div 60 % 1440").alias("minute"), "service",
        F.struct("us", "event_id").alias("seq"),
    )
    return readers.truth_by_minute(rows, ["day", "minute"], "seq")


@query(
    "s14_reference_texts",
    "SELECT CAST(conv_id AS VARCHAR) AS case_id, role || '_' || turn AS expert, text FROM conversations",
)
def s14(t):
    c = t.table("conversations")
    entry = F.struct(F.concat_ws("_", "role", "turn").alias("key"), F.col("text").alias("value"))
    docs = c.groupBy(F.col("conv_id").cast("string").alias("case_id")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("references")
    )
    out = run_dir(t.spark, "refs")
    docs.write.json(out)
    raw = t.spark.read.schema(readers.schemas.REFERENCE).json(out)
    return raw.select("case_id", F.explode("references").alias("expert", "text"))


@query(
    "s15_s16_partitioned_output",
    "SELECT incident_id, service, count(*) AS n FROM win_spans GROUP BY ALL",
)
def s15(t):
    out = run_dir(t.spark, "incidents")
    # by day instead of incident keeps the number of directories small
    rows = t.window_spans.withColumn("day", F.expr("fault_ts div 86400"))
    sinks.per_incident(rows, out, ("day",))
    got = t.spark.read.parquet(out).groupBy("incident_id", "service").agg(F.count("*").alias("n"))
    sinks.report(got, run_dir(t.spark, "report"))
    return got


@query(
    "s17_append_normal_rows",
    "SELECT service, count(*) AS n FROM spans WHERE status = 0 GROUP BY service",
)
def s17(t):
    out = run_dir(t.spark, "normal")
    rows = t.spans.filter("status = 0").select("trace_id", "span_id", "service")
    sinks.append_rows(rows.filter("span_id <= 3"), out)
    sinks.append_rows(rows.filter("span_id > 3"), out)
    got = t.spark.read.schema("trace_id long, span_id long, service string").option("header", True).csv(out)
    return got.groupBy("service").agg(F.count("*").alias("n"))


@query(
    "s18_s21_resume",
    """SELECT incident_id, strftime(to_timestamp(fault_ts) AT TIME ZONE 'UTC', '%m%d') AS date, strftime(to_timestamp(fault_ts) AT TIME ZONE 'UTC', '%H-%M') AS time FROM incidents
WHERE day >= 19740 AND (strftime(to_timestamp(fault_ts) AT TIME ZONE 'UTC', '%m%d %H-%M')) NOT IN (SELECT strftime(to_timestamp(fault_ts) AT TIME ZONE 'UTC', '%m%d %H-%M') FROM incidents WHERE day < 19740)""",
)
def s18(t):
    at = F.timestamp_seconds("fault_ts")
    keyed = t.incidents.select(
        "incident_id", "day", F.date_format(at, "MMdd").alias("date"), F.date_format(at, "HH-mm").alias("time")
    )
    out = run_dir(t.spark, "done")
    keyed.filter("day < 19740").select(F.concat_ws(" ", F.lit("INFO [DONE]"), "date", "time")).write.text(out)
    done = readers.finished_keys(t.spark, out)
    return readers.remaining(keyed, done, ["date", "time"]).select("incident_id", "date", "time")
