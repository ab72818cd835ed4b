"""Explicit schemas of the raw inputs; nothing is inferred."""

SPANS_A = (
    "timestamp string, host_ip string, service_name string, trace_id string, span_id string, "
    "parent_id string, start_time string, end_time string, url string, status_code string, message string"
)
SPANS_B = (
    "timestamp long, cmdb_id string, span_id string, trace_id string, duration long, type string, "
    "status_code string, operation_name string, parent_span string"
)
METRIC_CONTAINER = "timestamp long, cmdb_id string, value double"
METRIC_SERVICE = "service string, timestamp long, rr double, sr double, mrt double, count double"
METRIC_NODE = "timestamp long, cmdb_id string, kpi_name string, value double"
METRIC_A = "timestamp long, value double"
LOG_B = "timestamp long, cmdb_id string, value string"
RUN_TABLE = "datetime string, service string, message string"
TRUTH_ROWS = "timestamp long, level string, cmdb_id string, failure_type string"
TRUTH_ARRAYS = (
    "timestamp array<long>, level array<string>, cmdb_id array<string>, failure_type array<string>"
)
REFERENCE = (
    "case_id string, date string, time string, ground_truth_service string, generated_at string, "
    "generation_model string, references map<string,string>, raw_generations map<string,string>"
)
