"""Queries that join telemetry to incident windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.numbers import r6
from faultline.operators import spans as sp
from faultline.operators import windows as win
from faultline.plans.registry import query
from faultline.sources.telemetry import EPOCH, METRIC_STEP, Telemetry


def metric_points(t: Telemetry):
    return t.metrics.withColumn("ts", F.col("t") * METRIC_STEP + EPOCH)


def metric_windows(t: Telemetry):
    """30 points of every metric around each fault; several steps of one query read them."""
    if not hasattr(t, "metric_windows"):
        t.metric_windows = win.point_windows(metric_points(t), t.incidents, ["metric"]).persist()
    return t.metric_windows


# 30 points of every metric around each fault, shared by later queries
MW = f"""
pts AS (SELECT *, t * {METRIC_STEP} + {EPOCH} AS ts, row_number() OVER (PARTITION BY metric ORDER BY t) - 1 AS pos,
    count(*) OVER (PARTITION BY metric) AS n FROM metrics),
mids AS (SELECT incident_id, fault_ts, metric, min(n) AS n, arg_min(pos, {{'d': abs(ts - fault_ts), 'p': pos}}) AS mid
  FROM incidents, pts GROUP BY ALL),
mw AS (SELECT m.incident_id, m.fault_ts, p.metric, p.service, p.kpi, p.t, p.ts, p.value, m.mid AS nearest_pos,
    CAST(p.pos - greatest(least(m.mid - 15, m.n - 30), 0) AS BIGINT) AS k
  FROM mids m JOIN pts p ON p.metric = m.metric WHERE m.n >= 30
    AND p.pos BETWEEN greatest(least(m.mid - 15, m.n - 30), 0) AND greatest(least(m.mid - 15, m.n - 30), 0) + 29)
"""


@query(
    "j1_fault_window_spans",
    """SELECT i.incident_id, s.trace_id, s.span_id, s.ts FROM spans s JOIN incidents i
ON s.ts >= greatest(i.fault_ts - 180, i.fault_ts - i.fault_ts % 86400)
AND s.ts < least(i.fault_ts + 180, i.fault_ts - i.fault_ts % 86400 + 86399)""",
)
def j1(t):
    return win.fault_window_rows(t.spans, t.incidents).select("incident_id", "trace_id", "span_id", "ts")


@query(
    "j2_normal_spans",
    """SELECT trace_id, span_id, ts FROM spans s WHERE NOT EXISTS
(SELECT 1 FROM incidents i WHERE s.ts >= i.fault_ts - 300 AND s.ts < i.fault_ts + 300)""",
)
def j2(t):
    return win.normal_rows(t.spans, t.incidents).select("trace_id", "span_id", "ts")


@query(
    "j3_wide_window_spans",
    "SELECT incident_id, fault_service, trace_id, span_id, service, duration, ts - fault_ts AS offset_s FROM win_spans",
)
def j3(t):
    return t.window_spans.select(
        "incident_id", "fault_service", "trace_id", "span_id", "service", "duration",
        (F.col("ts") - F.col("fault_ts")).alias("offset_s"),
    )


@query(
    "j4_day_wide_traces",
    """tr AS (SELECT trace_id, min(ts) AS start_ts, count(*) AS span_count FROM spans GROUP BY trace_id)
SELECT incident_id, count(*) AS n_traces, CAST(sum(span_count) AS BIGINT) AS n_spans FROM tr JOIN incidents i
ON start_ts >= fault_ts - 86400 AND start_ts <= fault_ts + 86400 GROUP BY incident_id""",
)
def j4(t):
    windows = t.incidents.select(
        "incident_id",
        (F.col("fault_ts") - win.DAY).alias("win_start"),
        (F.col("fault_ts") + win.DAY).alias("win_end"),
    )
    traces = sp.trace_summary(t.spans)
    return win.window_totals(
        traces, windows, "start_ts",
        {"n_traces": F.count("*"), "n_spans": F.sum("span_count")}, 2 * win.DAY,
    )


@query(
    "j5_log_window",
    """SELECT i.incident_id, l.service, count(*) AS n_lines,
  count(*) FILTER (contains(l.message, 'ERROR')) AS n_errors FROM logs l JOIN incidents i
ON l.ts >= i.fault_ts - 1800 AND l.ts <= i.fault_ts + 1800 GROUP BY ALL""",
)
def j5_logs(t):
    joined = win.spans_in_windows(t.logs, t.fault_windows)
    return joined.groupBy("incident_id", "service").agg(
        F.count("*").alias("n_lines"),
        F.count_if(F.col("message").contains("ERROR")).alias("n_errors"),
    )


@query(
    "j5_metric_window",
    f"""pts AS (SELECT *, t * {METRIC_STEP} + {EPOCH} AS ts FROM metrics)
SELECT i.incident_id, p.metric, p.t, p.value FROM pts p JOIN incidents i
ON p.ts >= i.fault_ts - 86400 AND p.ts <= i.fault_ts + 86400""",
)
def j5_metrics(t):
    windows = t.incidents.select(
        "incident_id",
        (F.col("fault_ts") - win.DAY).alias("win_start"),
        (F.col("fault_ts") + win.DAY).alias("win_end"),
    )
    return win.spans_in_windows(metric_points(t), windows, 2 * win.DAY).select(
        "incident_id", "metric", "t", "value"
    )


@query(
    "j7_closest_minute",
    """f AS (SELECT DISTINCT ts // 60 % 1440 AS minute FROM ev WHERE event_type = 'purchase'),
i AS (SELECT incident_id, fault_ts // 60 % 1440 AS minute FROM incidents),
c AS (SELECT i.incident_id, i.minute, f.minute AS file_minute, abs(f.minute - i.minute) AS distance,
  row_number() OVER (PARTITION BY incident_id ORDER BY abs(f.minute - i.minute), f.minute) AS rn FROM i, f)
SELECT incident_id, minute, lpad(CAST(file_minute // 60 AS VARCHAR), 2, '0') || '-' ||
  lpad(CAST(file_minute % 60 AS VARCHAR), 2, '0') AS label, distance FROM c WHERE rn = 1""",
)
def j7(t):
    minute = F.expr("ts div 60 % 1440")
    files = (
        t.events.filter("event_type = 'purchase'")
        .select(minute.alias("file_minute"))
        .distinct()
        .withColumn("file", F.col("file_minute"))
    )
    cases = t.incidents.select("incident_id", F.expr("fault_ts div 60 % 1440").alias("minute"))
    near = win.nearest_join(cases, files, "minute", "file_minute", "file")
    label = F.format_string("%02d-%02d", F.expr("file div 60"), F.expr("file % 60"))
    return near.select("incident_id", "minute", label.alias("label"), "distance")


@query(
    "j8_truth_lookup",
    """case_ev AS (SELECT event_id AS case_id, ts // 60 AS minute, ts // 86400 AS day FROM ev WHERE event_type = 'view'),
truth AS (SELECT day, fault_ts // 60 AS minute, min(service) AS service FROM incidents GROUP BY ALL),
c AS (SELECT c.case_id, t.service, abs(t.minute - c.minute) AS distance,
  row_number() OVER (PARTITION BY c.case_id ORDER BY abs(t.minute - c.minute), t.minute) AS rn
  FROM case_ev c JOIN truth t ON t.day = c.day AND abs(t.minute - c.minute) <= 10)
SELECT case_ev.case_id, c.service AS truth, c.distance FROM case_ev LEFT JOIN c ON c.case_id = case_ev.case_id AND rn = 1""",
)
def j8(t):
    cases = t.events.filter("event_type = 'view'").select(
        F.col("event_id").alias("case_id"),
        F.expr("ts div 60").alias("minute"),
        F.expr("ts div 86400").alias("day"),
    )
    truth = t.incidents.select(
        "day", F.expr("fault_ts div 60").alias("truth_minute"), F.col("service").alias("truth")
    )
    return win.nearest_join(cases, truth, "minute", "truth_minute", "truth", ["day"], 10).select(
        "case_id", "truth", "distance"
    )


@query(
    "j9_nearest_sample",
    MW + "SELECT DISTINCT incident_id, metric, CAST(nearest_pos AS BIGINT) AS nearest_pos FROM mw",
)
def j9(t):
    return metric_windows(t).filter("k = 0").select("incident_id", "metric", "nearest_pos")


@query("w7_point_window", MW + "SELECT incident_id, metric, k, t, value FROM mw")
def w7(t):
    return metric_windows(t).select("incident_id", "metric", "k", "t", "value")


@query(
    "j10_baseline",
    f"""pts AS (SELECT *, t * {METRIC_STEP} + {EPOCH} AS ts FROM metrics)
SELECT incident_id, metric, count(*) AS n,
  round(CASE WHEN count(*) < 5 THEN 0.0 ELSE avg(value) END, 6) AS base_mean,
  round(CASE WHEN count(*) < 5 THEN 1.0 WHEN stddev_samp(value) = 0 THEN 1e-6 ELSE stddev_samp(value) END, 6) AS base_std
FROM pts p JOIN incidents i ON p.ts >= i.fault_ts - {20 * METRIC_STEP} AND p.ts <= i.fault_ts - {10 * METRIC_STEP}
GROUP BY incident_id, metric""",
)
def j10(t):
    base = win.baseline(
        metric_points(t), t.incidents, ["metric"], 20 * METRIC_STEP, 10 * METRIC_STEP
    )
    return base.select(
        "incident_id", "metric", "n", r6("base_mean", "base_mean"), r6("base_std", "base_std")
    )


@query(
    "j13_prediction_truth_by_minute",
    """pred AS (SELECT ts // 60 % 1440 AS minute, arg_max(service, {'a': us, 'b': event_id}) AS predicted
  FROM ev WHERE event_type = 'click' GROUP BY 1),
truth AS (SELECT fault_ts // 60 % 1440 AS minute, arg_max(service, {'a': fault_ts, 'b': incident_id}) AS truth
  FROM incidents GROUP BY 1)
SELECT minute, predicted, truth, predicted = truth AS hit FROM pred JOIN truth USING (minute)""",
)
def j13(t):
    pred = (
        t.events.filter("event_type = 'click'")
        .groupBy(F.expr("ts div 60 % 1440").alias("minute"))
        .agg(F.max_by("service", F.struct("us", "event_id")).alias("predicted"))
    )
    truth = t.incidents.groupBy(F.expr("fault_ts div 60 % 1440").alias("minute")).agg(
        F.max_by("service", F.struct("fault_ts", "incident_id")).alias("truth")
    )
    return pred.join(truth, "minute").withColumn("hit", F.col("predicted") == F.col("truth"))


@query(
    "w11_minute_fold",
    """SELECT fault_ts // 60 % 1440 AS minute, count(*) AS n_cases, max(fault_ts // 60) AS kept_key,
  arg_max(service, (fault_ts // 60) * 100 + CAST(service[4:] AS INT)) AS service FROM incidents GROUP BY 1""",
)
def w11(t):
    key = F.expr("fault_ts div 60")
    return t.incidents.groupBy(F.expr("fault_ts div 60 % 1440").alias("minute")).agg(
        F.count("*").alias("n_cases"),
        F.max(key).alias("kept_key"),
        F.max_by("service", F.struct(key, "service")).alias("service"),
    )


@query(
    "m3_training_labels",
    """tr AS (SELECT incident_id, trace_id, min(ts) AS start_ts, min(fault_ts) AS fault_ts,
  max(CASE WHEN service = fault_service THEN 1 ELSE 0 END) AS has_fault FROM win_spans GROUP BY ALL)
SELECT incident_id, trace_id, CASE WHEN start_ts - fault_ts <= 60 AND has_fault = 1 THEN 1 ELSE 0 END AS as_coded,
  CASE WHEN abs(start_ts - fault_ts) <= 60 AND has_fault = 1 THEN 1 ELSE 0 END AS label FROM tr""",
)
def m3(t):
    traces = t.window_spans.groupBy("incident_id", "trace_id").agg(
        (F.min("ts") - F.min("fault_ts")).alias("d"),
        F.max((F.col("service") == F.col("fault_service")).cast("int")).alias("has"),
    )
    signed = (F.col("d") <= 60) & (F.col("has") == 1)
    near = (F.abs("d") <= 60) & (F.col("has") == 1)
    return traces.select(
        "incident_id", "trace_id", signed.cast("int").alias("as_coded"), near.cast("int").alias("label")
    )
