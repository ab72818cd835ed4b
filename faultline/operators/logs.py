"""Run logs and service logs: case segmentation, typed fields, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.scale import lookup_join, running_last, top_k

# fixed values: line formats and text budgets
RECORD_PATTERN = r"\[EVAL\]\s*(\{.*\})\s*$"
PHASE_PATTERN = r"\[(Phase \d+)\]\s+completed in\s+([\d.]+)s"
RECORD_SCHEMA = (
    "type string, date string, time string, method string, predictions array<string>, "
    "channel string, metrics string, agent string, text string, duration_s double"
)
NOISE = ("trace_id", "traci_id")
SERVICE_BUDGET, TOTAL_BUDGET = 1000, 4000
ERROR_WORDS = "(?i)error|exception|fail|fatal"
WARN_WORDS = "(?i)warn|caution"
AGENT_NAMES = {
    "TraceAnalysis": "TraceExpert",
    "MetricAnalysis": "MetricExpert",
    "LogAnalysis": "LogExpert",
    "TradeAnalysis": "TradeExpert",
    "CMDBAnalysis": "CMDBExpert",
    "RootCauseAnalysis": "RootCauseExpert",
    "TraceExpert": "TraceExpert",
    "MetricExpert": "MetricExpert",
    "LogExpert": "LogExpert",
}


def with_records(lines: DataFrame) -> DataFrame:
    """Parse tagged JSON records and phase durations; a broken record stays null."""
    body = F.regexp_extract("line", RECORD_PATTERN, 1)
    phase = F.regexp_extract("line", PHASE_PATTERN, 1)
    return (
        lines.withColumn("record", F.when(body != "", F.from_json(body, RECORD_SCHEMA)))
        .withColumn("phase", F.when(phase != "", phase))
        .withColumn("phase_s", F.when(phase != "", F.regexp_extract("line", PHASE_PATTERN, 2).try_cast("double")))
    )


def segment_cases(lines: DataFrame, is_open: Column, keys=("file",), position: str = "pos") -> DataFrame:
    """Add case_pos, the position of the last opener; lines before the first opener are dropped."""
    opener = F.when(is_open, F.col(position))
    return running_last(lines, list(keys), position, opener, "case_pos").filter(F.col("case_pos").isNotNull())


def first_and_last(lines: DataFrame, keys: list[str], position: str, first: dict, last: dict) -> DataFrame:
    """Per case, the first value of some fields and the last value of others, nulls skipped."""
    picks = [F.min(F.when(c.isNotNull(), F.struct(F.col(position), c.alias("v"))))["v"].alias(n) for n, c in first.items()]
    picks += [F.max(F.when(c.isNotNull(), F.struct(F.col(position), c.alias("v"))))["v"].alias(n) for n, c in last.items()]
    return lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), *picks)


def agent_name(raw: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in AGENT_NAMES.items() for x in kv]), raw), raw)


def within_budget(rows: DataFrame, keys: list[str], order: list, text: str, budget: int, over_by_one: bool = True) -> DataFrame:
    """Rows of a group until its text reaches the budget.

    With ``over_by_one`` the row that crosses the budget is still kept. Every kept row has at least
    one character, so the first ``budget`` + 1 rows of a group hold all of them; they are picked
    with a skew-safe top-k before the running length is taken.
    """
    rows = top_k(rows.filter(F.length(text) > 0), keys, order, budget + 1, "_pos")
    upto = Window.partitionBy(*keys).orderBy("_pos")
    before = F.coalesce(F.sum(F.length(text)).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if over_by_one:
        rows = rows.withColumn("_used", before).filter(F.col("_used") <= budget)
    else:
        total = F.sum(F.length(text)).over(upto.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_used", total).filter(F.col("_used") <= budget)
    return rows.drop("_pos", "_used")


def error_excerpt(lines: DataFrame, services: DataFrame) -> DataFrame:
    """Error lines of the named services: about 1000 characters each, 4000 per incident.

    lines is (incident_id, service, ts, event_id, message), services (incident_id, service).
    """
    m = F.col("message")
    kept = lines.filter(m.contains("ERROR") & ~m.contains(NOISE[0]) & ~m.contains(NOISE[1]))
    kept = kept.join(services.distinct(), ["incident_id", "service"], "left_semi")
    kept = within_budget(kept, ["incident_id", "service"], ["ts", "event_id"], "message", SERVICE_BUDGET)
    return within_budget(kept, ["incident_id"], ["service", "ts", "event_id"], "message", TOTAL_BUDGET)


def log_features(lines: DataFrame, keys: list[str], message: str = "message") -> DataFrame:
    """Eight features per node from its log lines."""
    n = F.count("*").cast("double")
    errors = F.count_if(F.col(message).rlike(ERROR_WORDS)).cast("double")
    warns = F.count_if(F.col(message).rlike(WARN_WORDS)).cast("double")
    size = F.length(message).cast("double")
    return lines.groupBy(*keys).agg(
        F.log1p(n).alias("log_lines"),
        F.log1p(errors).alias("log_errors"),
        F.log1p(warns).alias("log_warns"),
        (errors / n).alias("error_rate"),
        (warns / n).alias("warn_rate"),
        F.lit(1.0).alias("has_logs"),
        F.log1p(F.avg(size)).alias("log_mean_len"),
        F.stddev_pop(size).alias("std_len"),
    )


def usage_totals(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Token totals and cost per model from a rate table (per 1000 tokens)."""
    joined = lookup_join(calls, rates, ["model"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return joined.groupBy("model").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        (
            F.sum(F.col("prompt_tokens") * zero("input_rate") / 1000.0)
            + F.sum(F.col("completion_tokens") * zero("output_rate") / 1000.0)
        ).alias("cost"),
    )
