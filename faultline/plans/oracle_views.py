"""The telemetry rules of ``sources.telemetry`` as SQL views, for checking in DuckDB."""

VIEWS: dict[str, str] = {
    "spans": """
SELECT l_orderkey AS trace_id, CAST(l_linenumber AS BIGINT) AS span_id,
  CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber // 2 AS BIGINT) END AS parent_span_id,
  'svc' || CAST(min(l_suppkey) % 10 AS VARCHAR) AS service,
  max(l_extendedprice) / 100 AS duration,
  CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS status,
  CAST(1704067200 + (l_orderkey * 7919) % 2592000 + l_linenumber - 1 AS BIGINT) AS ts
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "ev": """
SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS ts, user_id, event_type, value,
  props, 'svc' || CAST(user_id % 10 AS VARCHAR) AS service FROM events""",
    "incidents": """
SELECT event_id AS incident_id, ts AS fault_ts, service, ts // 86400 AS day,
  CASE WHEN value < 10 THEN 'latency' WHEN value < 20 THEN 'error' ELSE 'resource' END AS failure_type,
  CASE event_id % 3 WHEN 0 THEN 'pod' WHEN 1 THEN 'service' ELSE 'node' END AS level
FROM (SELECT *, row_number() OVER (PARTITION BY service, ts // 86400 ORDER BY us, event_id) AS rn
      FROM ev WHERE event_type = 'error') WHERE rn = 1""",
    "metrics": """
SELECT 'svc' || CAST(user_id % 3 AS VARCHAR) AS service, event_type AS kpi,
  (ts - 1704067200) // 21600 AS t,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (100.0::DOUBLE * count(*)) AS value,
  'svc' || CAST(user_id % 3 AS VARCHAR) || '_' || event_type AS metric
FROM ev GROUP BY user_id % 3, event_type, (ts - 1704067200) // 21600""",
    "logs": """
SELECT event_id, ts, service,
  concat_ws(' ', CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END,
    event_type, CASE WHEN event_type = 'signup' THEN 'trace_id=' || CAST(user_id AS VARCHAR) END,
    props) AS message FROM ev""",
    "win_spans": """
SELECT s.*, i.incident_id, i.fault_ts, i.service AS fault_service
FROM spans s JOIN incidents i ON s.ts >= i.fault_ts - 1800 AND s.ts <= i.fault_ts + 1800""",
}
