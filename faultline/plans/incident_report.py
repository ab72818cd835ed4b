"""The whole analysis of all incidents as one job: windows, scores, scenario, fusion, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import fusion
from faultline.operators import windows as win
from faultline.plans import rankings as rk
from faultline.plans.registry import query
from faultline.sources.telemetry import Telemetry

REPORT_SQL = (
    rk.fuse_sql(rk.ONE.format(c="false", p="true", l="false")).rstrip()
    + """,
fl AS (SELECT incident_id, string_agg(service, ',' ORDER BY rank) AS services, round(max(score), 6) AS top_score FROM fused GROUP BY 1),
lg AS (SELECT i.incident_id, count(*) AS error_lines FROM logs l JOIN incidents i ON l.ts >= i.fault_ts - 1800 AND l.ts <= i.fault_ts + 1800
  WHERE contains(l.message, 'ERROR') GROUP BY 1),
sn AS (SELECT incident_id, count(*) AS n_spans, count(DISTINCT trace_id) AS n_traces FROM win_spans GROUP BY 1)
SELECT scen.incident_id, scenario, services, top_score, 'Top 5 root cause metrics is:(1)' || ul[1] || ',(2)' || ul[2] || ',(3)' || ul[3] || ',(4)' || ul[4] || ',(5)' || ul[5] || '.' AS univariate,
  n_spans, n_traces, coalesce(error_lines, 0) AS error_lines
FROM scen JOIN fl USING (incident_id) JOIN sn USING (incident_id) LEFT JOIN lg USING (incident_id)"""
)


@query("full_incident_report", REPORT_SQL)
def incident_report(t: Telemetry) -> DataFrame:
    from faultline.functions.numbers import r6

    fused = rk.fused(t)
    services = fused.groupBy("incident_id").agg(
        F.array_join(fusion.names_in_order(name="service"), ",").alias("services"),
        r6(F.max("score"), "top_score"),
    )
    per_trace = t.window_spans.groupBy("incident_id", "trace_id").agg(F.count("*").alias("c"))
    volume = per_trace.groupBy("incident_id").agg(F.sum("c").alias("n_spans"), F.count("*").alias("n_traces"))
    errors = (
        win.spans_in_windows(t.logs.filter(F.col("message").contains("ERROR")), t.fault_windows)
        .groupBy("incident_id")
        .agg(F.count("*").alias("error_lines"))
    )
    return (
        rk.channel_tops(t)
        .select("incident_id", "scenario", F.col("uni_text").alias("univariate"))
        .join(services, "incident_id")
        .join(volume, "incident_id")
        .join(errors, "incident_id", "left")
        .withColumn("error_lines", F.coalesce("error_lines", F.lit(0)))
    )
