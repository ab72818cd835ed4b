"""Queries on field projections, run logs, event strings and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import projections as pj
from faultline.functions.numbers import r6
from faultline.operators import detect, eventtext, fusion, logs
from faultline.operators import windows as win
from faultline.operators import spans as sp
from faultline.operators.scale import global_index
from faultline.plans import rankings as rk
from faultline.plans.evaluate import rounded
from faultline.plans.registry import query
from faultline.plans.scores import CLASSED, ERR, TRAIN, window_shapes
from faultline.plans.windows import MW, metric_windows

NODES = [f"svc{i}" for i in range(10)]
PODS = [f"svc{i}-{j}" for i in range(5) for j in range(2)]

# -- projections ---------------------------------------------------------------------------------


def raw_spans(t):
    """Spans as text fields, the way raw exports hold them."""
    us = F.col("ts") * 1_000_000 + F.col("span_id") * 1000
    text = lambda c, f: F.date_format(F.timestamp_micros(c), f)
    odd = F.col("span_id") == 2
    end = us + F.floor(F.col("duration") * 1000)
    return t.spans.select(
        "trace_id", "span_id", "service", "duration",
        F.when(odd, text(F.col("ts") * 1_000_000, "yyyy-MM-dd HH:mm:ss")).otherwise(text(us, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("start_time"),
        F.when(F.col("span_id") == 7, "bad").otherwise(text(end, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("end_time"),
        F.when(F.col("parent_span_id").isNull(), F.when(F.col("trace_id") > 5000, "nan").otherwise("")).otherwise(F.col("parent_span_id").cast("string")).alias("parent_id"),
        F.when(F.col("status") == 1, "500").when(F.col("span_id") == 1, "OK").when(F.col("span_id") == 3, "n/a").otherwise("200").alias("status_code"),
    )


@query(
    "p1_duration_from_text",
    """SELECT trace_id, span_id, CASE WHEN span_id = 7 THEN NULL WHEN span_id = 2 THEN (span_id * 1000 + CAST(floor(duration * 1000) AS BIGINT)) / 1000.0::DOUBLE
  ELSE CAST(floor(duration * 1000) AS BIGINT) / 1000.0::DOUBLE END AS duration_ms FROM spans""",
)
def p1(t):
    ms = pj.duration_ms(F.col("start_time"), F.col("end_time"))
    return raw_spans(t).select("trace_id", "span_id", ms.alias("duration_ms"))


@query(
    "p2_p3_p4_normalised_fields",
    """SELECT trace_id, span_id, CAST(parent_span_id AS VARCHAR) AS parent_id, CASE WHEN status = 1 THEN 500 ELSE 0 END AS status_code, CAST(status AS INTEGER) AS abnormal FROM spans""",
)
def p2(t):
    code = F.col("status_code")
    return raw_spans(t).select(
        "trace_id", "span_id", pj.parent_id(F.col("parent_id")).alias("parent_id"),
        pj.status_code(code).alias("status_code"), pj.is_abnormal(code).alias("abnormal"),
    )


@query(
    "p5_entity_to_service",
    """SELECT event_id, 'svc' || CAST(user_id % 10 AS VARCHAR) || '-0' AS pod, 'svc' || CAST(user_id % 10 AS VARCHAR) AS service FROM ev""",
)
def p5(t):
    node_pod = F.concat(F.lit("node-1."), "service", F.lit("-0"))
    return t.events.select(
        "event_id",
        pj.container_service(node_pod).alias("pod"),
        pj.grpc_service(F.concat("service", F.lit("-grpc"))).alias("service"),
    )


@query(
    "p6_metric_to_service",
    "SELECT metric, t, service AS by_underscore, CASE WHEN starts_with(metric, 'svc1_cl') THEN 'svc1_cl' ELSE service END AS by_prefix FROM metrics",
)
def p6(t):
    m = F.col("metric")
    return t.metrics.select(
        "metric", "t", pj.metric_service(m).alias("by_underscore"),
        pj.metric_service(m, ["svc", "svc0", "svc1", "svc2", "svc1_cl"]).alias("by_prefix"),
    )


@query(
    "p7_entity_map",
    """SELECT incident_id, level, CASE WHEN level = 'pod' AND CAST(service[4:] AS INT) < 5 THEN service || '-0'
  WHEN level = 'service' AND CAST(service[4:] AS INT) < 5 THEN service || '-0' END AS mapped FROM incidents""",
)
def p7(t):
    entity = F.when(F.col("level") == "pod", F.concat("service", F.lit("-0"))).otherwise(F.col("service"))
    return t.incidents.select(
        "incident_id", "level", pj.entity_to_service(entity, F.col("level"), PODS).alias("mapped")
    )


LOCAL = "(to_timestamp(fault_ts + 28800) AT TIME ZONE 'UTC')"


@query(
    "p8_f14_window_labels",
    f"""SELECT incident_id, strftime({LOCAL}, '%H-%M') AS label, strftime({LOCAL}, '%Y-%m-%d_%H-%M') AS full_label, strftime({LOCAL}, '%m%d') AS month_day,
  strftime({LOCAL}, '%m%d') || CASE incident_id % 4 WHEN 0 THEN 't' WHEN 1 THEN '' WHEN 2 THEN 'b' ELSE 'c' END AS prefix FROM incidents""",
)
def p8(t):
    ts = F.col("fault_ts")
    n = F.col("incident_id") % 4
    cluster = F.when(n == 0, "cluster").otherwise(F.concat(F.lit("cluster-"), n))
    return t.incidents.select(
        "incident_id", pj.minute_label(ts).alias("label"), pj.minute_label(ts, True).alias("full_label"),
        pj.month_day(ts).alias("month_day"), pj.directory_prefix(pj.month_day(ts), cluster).alias("prefix"),
    )


UTC = "(to_timestamp({c}) AT TIME ZONE 'UTC')"


@query(
    "p9_p10_request_times",
    f"""SELECT event_id, 'At ' || CAST(ts - ts % 60 AS VARCHAR) || ' and ' || CAST(ts - ts % 60 + 3600 AS VARCHAR) || ' have exceptions' AS swapped,
  strftime({UTC.format(c='ts')}, '%m%d') AS month_day, strftime({UTC.format(c='ts')}, '%H-%M') AS label FROM ev""",
)
def p9(t):
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy/MM/dd HH:mm")
    text = F.concat(F.lit("At "), stamp(F.col("ts")), F.lit(" and "), stamp(F.col("ts") + 3600), F.lit(" have exceptions"))
    rows = t.events.withColumn("text", text)
    day, label = pj.task_time(F.col("text"))
    return rows.select("event_id", pj.dates_to_epoch(F.col("text")).alias("swapped"), day.alias("month_day"), label.alias("label"))


@query(
    "p12_kpi_selection",
    "SELECT metric, t, kpi IN ('click', 'view') AS by_list, contains(kpi, 'ur') OR contains(kpi, 'err') AS by_keyword FROM metrics",
)
def p12(t):
    kpi = F.col("kpi")
    return t.metrics.select(
        "metric", "t", kpi.isin("click", "view").alias("by_list"), pj.has_keyword(kpi, ["ur", "err"]).alias("by_keyword")
    )


@query(
    "f16_fixed_decimals",
    "SELECT metric, t, CAST(CAST(round(CAST(value AS DECIMAL(38,12)), 4) AS DECIMAL(24,4)) AS VARCHAR) AS four, CAST(CAST(round(CAST(value AS DECIMAL(38,12)), 2) AS DECIMAL(24,2)) AS VARCHAR) AS two FROM metrics",
)
def f16(t):
    from faultline.functions.numbers import fixed

    return t.metrics.select("metric", "t", fixed("value", 4).alias("four"), fixed("value", 2).alias("two"))


# -- service logs --------------------------------------------------------------------------------


@query(
    "a9_log_features",
    """SELECT service, round(ln(1 + count(*)), 6) AS log_lines, round(ln(1 + count(*) FILTER (regexp_matches(message, '(?i)error|exception|fail|fatal'))), 6) AS log_errors,
  round(ln(1 + count(*) FILTER (regexp_matches(message, '(?i)warn|caution'))), 6) AS log_warns,
  round(count(*) FILTER (regexp_matches(message, '(?i)error|exception|fail|fatal'))::DOUBLE / count(*), 6) AS error_rate,
  round(count(*) FILTER (regexp_matches(message, '(?i)warn|caution'))::DOUBLE / count(*), 6) AS warn_rate, 1.0::DOUBLE AS has_logs,
  round(ln(1 + avg(length(message))), 6) AS log_mean_len, round(stddev_pop(length(message)), 6) AS std_len FROM logs GROUP BY service""",
)
def a9(t):
    out = logs.log_features(t.logs, ["service"])
    return rounded(out, *out.columns[1:])


@query(
    "a9_document_features",
    """SELECT source, round(ln(1 + count(*)), 6) AS log_lines, round(ln(1 + avg(length(text))), 6) AS log_mean_len, round(stddev_pop(length(text)), 6) AS std_len FROM documents GROUP BY source""",
)
def a9_docs(t):
    out = logs.log_features(t.table("documents"), ["source"], "text").select("source", "log_lines", "log_mean_len", "std_len")
    return rounded(out, *out.columns[1:])


EXCERPT = """
tops AS (SELECT incident_id, service FROM (SELECT incident_id, service, row_number() OVER (PARTITION BY incident_id ORDER BY max(duration) DESC, service) AS rk FROM win_spans GROUP BY incident_id, service) WHERE rk <= 5),
lw AS (SELECT i.incident_id, l.* FROM logs l JOIN incidents i ON l.ts >= i.fault_ts - 86400 AND l.ts <= i.fault_ts + 86400),
er AS (SELECT lw.* FROM lw SEMI JOIN tops USING (incident_id, service) WHERE contains(message, 'ERROR') AND NOT contains(message, 'trace_id') AND NOT contains(message, 'traci_id')),
s1 AS (SELECT *, coalesce(sum(length(message)) OVER (PARTITION BY incident_id, service ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM er),
s2 AS (SELECT incident_id, service, ts, event_id, message, coalesce(sum(length(message)) OVER (PARTITION BY incident_id ORDER BY service, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s1 WHERE used <= 1000)
SELECT incident_id, event_id, service, message FROM s2 WHERE used <= 4000"""


@query("p14_error_log_excerpt", EXCERPT)
def p14(t):
    anchor = rk.span_lists(t)[0].filter("rank <= 5").select("incident_id", "service")
    day = t.incidents.select(
        "incident_id", (F.col("fault_ts") - win.DAY).alias("win_start"), (F.col("fault_ts") + win.DAY).alias("win_end")
    )
    lines = win.spans_in_windows(t.logs.filter(F.col("message").contains("ERROR")), day, 2 * win.DAY)
    return logs.error_excerpt(lines, anchor).select("incident_id", "event_id", "service", "message")


@query(
    "p15_substring_service_filter",
    """tops AS (SELECT incident_id, service FROM (SELECT incident_id, service, row_number() OVER (PARTITION BY incident_id ORDER BY max(duration) DESC, service) AS rk FROM win_spans GROUP BY incident_id, service) WHERE rk <= 5),
n AS (SELECT DISTINCT metric FROM metrics)
SELECT DISTINCT tops.incident_id, n.metric FROM tops JOIN n ON contains(n.metric, tops.service)""",
)
def p15(t):
    # a metric name holds a service iff the service is one of its underscore-free prefixes
    anchor = rk.span_lists(t)[0].filter("rank <= 5").select("incident_id", "service")
    names = t.metrics.select("metric").distinct()
    owners = F.filter(F.array(*map(F.lit, NODES)), lambda n: F.contains(F.col("metric"), n))
    held = names.select("metric", F.explode(owners).alias("service"))
    return anchor.join(held, "service").select("incident_id", "metric").distinct()


@query(
    "p16_description_budget",
    CLASSED
    + """,
tx AS (SELECT incident_id, metric, metric || ' is ' || severity || ' with score ' || score AS description FROM sv),
c AS (SELECT *, coalesce(sum(length(description)) OVER (PARTITION BY incident_id ORDER BY metric ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM tx)
SELECT incident_id, metric, description FROM c WHERE used <= 300""",
)
def p16(t):
    from faultline.operators.patterns import deviation_scores

    text = F.concat("metric", F.lit(" is "), "severity", F.lit(" with score "), F.col("score").cast("string"))
    rows = deviation_scores(window_shapes(t)).select("incident_id", "metric", text.alias("description"))
    return logs.within_budget(rows, ["incident_id"], ["metric"], "description", 300)


# -- run logs ------------------------------------------------------------------------------------

LINES = """
ln0 AS (SELECT 'log' || CAST(user_id % 3 AS VARCHAR) AS file, event_id AS pos, event_type, service, value, CASE event_type
  WHEN 'signup' THEN 'x [EVAL] {"type":"task_parsed","date":"' || strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%m%d') || '","time":"' || strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%H-%M') || '"}'
  WHEN 'error' THEN '[EVAL] {"type":"localization","method":"anchor","predictions":["' || service || '","svc0"]}'
  WHEN 'purchase' THEN '[EVAL] {"type":"e2e_latency","duration_s":' || value || '}'
  WHEN 'click' THEN 'INFO [Phase ' || (user_id % 6) || '] completed in ' || value || 's' ELSE '[EVAL] {"type":"broken' END AS line,
  strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%m%d') AS dt FROM ev),
cs AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN pos END) OVER (PARTITION BY file ORDER BY pos) AS case_pos FROM ln0)
"""


def run_lines(t):
    """A run log: tagged records, phase lines and broken records, in event order."""
    at = F.timestamp_seconds("ts")
    kind = F.col("event_type")
    value = F.col("value").cast("string")
    line = (
        F.when(kind == "signup", F.concat(F.lit('x [EVAL] {"type":"task_parsed","date":"'), F.date_format(at, "MMdd"), F.lit('","time":"'), F.date_format(at, "HH-mm"), F.lit('"}')))
        .when(kind == "error", F.concat(F.lit('[EVAL] {"type":"localization","method":"anchor","predictions":["'), "service", F.lit('","svc0"]}')))
        .when(kind == "purchase", F.concat(F.lit('[EVAL] {"type":"e2e_latency","duration_s":'), value, F.lit("}")))
        .when(kind == "click", F.concat(F.lit("INFO [Phase "), F.col("user_id") % 6, F.lit("] completed in "), value, F.lit("s")))
        .otherwise('[EVAL] {"type":"broken')
    )
    return t.events.select(
        F.concat(F.lit("log"), F.col("user_id") % 3).alias("file"), F.col("event_id").alias("pos"), line.alias("line")
    )


@query("w9_case_segmentation", LINES + "SELECT file, pos, case_pos FROM cs WHERE case_pos IS NOT NULL")
def w9(t):
    parsed = logs.with_records(run_lines(t))
    cases = logs.segment_cases(parsed, F.col("record.type") == "task_parsed")
    return cases.select("file", "pos", "case_pos")


@query(
    "w10_s12_case_fields",
    LINES
    + """SELECT file, case_pos, count(*) AS n_lines, any_value(dt) FILTER (event_type = 'signup') AS date, arg_min(service, pos) FILTER (event_type = 'error') AS first_top1,
  arg_max(value, pos) FILTER (event_type = 'purchase') AS last_latency, count(*) FILTER (event_type = 'click') AS n_phases FROM cs WHERE case_pos IS NOT NULL GROUP BY ALL""",
)
def w10(t):
    parsed = logs.with_records(run_lines(t))
    cases = logs.segment_cases(parsed, F.col("record.type") == "task_parsed")
    fields = logs.first_and_last(
        cases, ["file", "case_pos"], "pos",
        {"date": F.col("record.date"), "first_top1": F.get("record.predictions", F.lit(0))},
        {"last_latency": F.col("record.duration_s")},
    )
    phases = cases.groupBy("file", "case_pos").agg(F.count("phase").alias("n_phases"))
    return fields.join(phases, ["file", "case_pos"])


@query(
    "f7_record_fields",
    LINES
    + """SELECT file, pos, CASE event_type WHEN 'signup' THEN 'task_parsed' WHEN 'error' THEN 'localization' WHEN 'purchase' THEN 'e2e_latency' END AS type,
  CASE WHEN event_type = 'error' THEN service END AS top1, CASE WHEN event_type = 'purchase' THEN value END AS duration_s, CASE WHEN event_type = 'click' THEN value END AS phase_s FROM ln0""",
)
def f7(t):
    return logs.with_records(run_lines(t)).select(
        "file", "pos", F.col("record.type").alias("type"), F.get("record.predictions", F.lit(0)).alias("top1"),
        F.col("record.duration_s").alias("duration_s"), "phase_s",
    )


@query(
    "f6_embedded_json",
    """SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM ev""",
)
def f6(t):
    from faultline.functions.texts import embedded_json

    # direct, inside a fence, or between other words
    body = F.col("props")
    fenced = F.concat(F.lit("answer:\n```json\n"), body, F.lit("\n```\nend"))
    text = F.when(F.col("event_type") == "click", fenced).when(F.col("event_type") == "view", F.concat(F.lit("so "), body, F.lit(" ok"))).otherwise(body)
    return t.events.select("event_id", F.from_json(embedded_json(text), "k int")["k"].alias("k"))


@query(
    "f6_truncated_json",
    """d AS (SELECT event_id, event_type, CAST(props->>'k' AS INTEGER) AS k, user_id FROM ev),
e AS (SELECT *, event_id % (length('{"event":"' || event_type || '","k":' || k || ',"user":' || user_id || ',"note":"cut"}') + 1) AS n,
  11 + length(event_type) AS e1 FROM d),
f AS (SELECT *, e1 + 5 + length(CAST(k AS VARCHAR)) AS k1 FROM e)
SELECT event_id, CASE WHEN n >= e1 THEN event_type END AS event, CASE WHEN n >= k1 + 1 THEN k END AS k,
  CASE WHEN n >= k1 + 9 + length(CAST(user_id AS VARCHAR)) THEN user_id END AS user FROM f""",
)
def f6_cut(t):
    from faultline.functions.texts import repaired_json

    # every document is cut somewhere; the pairs that are whole must come back
    k = F.from_json("props", "k int")["k"]
    parts = [F.lit('{"event":"'), "event_type", F.lit('","k":'), k, F.lit(',"user":'), "user_id", F.lit(',"note":"cut"}')]
    docs = t.events.select("event_id", F.concat(*[F.col(c) if isinstance(c, str) else c.cast("string") for c in parts]).alias("doc"))
    n = (F.col("event_id") % (F.char_length("doc") + 1)).cast("int")
    got = F.from_json(repaired_json(F.substring("doc", F.lit(1), n)), "event string, k int, user long")
    return docs.select("event_id", got.alias("j")).select("event_id", "j.event", "j.k", "j.user")


@query(
    "f10_agent_names",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'TraceExpert' WHEN 'view' THEN 'RootCauseExpert' ELSE event_type END AS agent FROM ev",
)
def f10(t):
    raw = F.when(F.col("event_type") == "click", "TraceAnalysis").when(F.col("event_type") == "view", "RootCauseAnalysis").otherwise(F.col("event_type"))
    return t.events.select("event_id", logs.agent_name(raw).alias("agent"))


@query(
    "f17_reference_text_cleaning",
    """l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, text FROM conversations),
k AS (SELECT *, trim(line, ' ') AS s FROM l)
SELECT conv_id, turn, count(*) FILTER (s <> '' AND NOT regexp_matches(lower(s), '^(la|the|in|on|et|en|therefore|okay)')) AS kept FROM k GROUP BY ALL""",
)
def f17(t):
    from faultline.functions.texts import kept_lines

    words = ["la", "the", "in", "on", "et", "en", "therefore", "okay"]
    return t.table("conversations").select(
        "conv_id", "turn", F.size(kept_lines(F.col("text"), words)).cast("long").alias("kept")
    )


@query(
    "a39_usage_totals",
    """r(model, i, o) AS (VALUES ('A', 0.001, 0.002), ('F', 0.03, 0.06), ('N', 0.01, 0.03)),
c AS (SELECT l_returnflag AS model, l_quantity AS p, l_linenumber AS q FROM lineitem)
SELECT model, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(q) AS BIGINT) AS completion_tokens, round(sum(p) * coalesce(any_value(i), 0) / 1000 + sum(q) * coalesce(any_value(o), 0) / 1000, 6) AS cost
FROM c LEFT JOIN r USING (model) GROUP BY model""",
)
def a39(t):
    calls = t.table("lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("long").alias("prompt_tokens"),
        F.col("l_linenumber").cast("long").alias("completion_tokens"),
    )
    rates = t.spark.createDataFrame([("A", 0.001, 0.002), ("F", 0.03, 0.06), ("N", 0.01, 0.03)], "model string, input_rate double, output_rate double")
    return rounded(logs.usage_totals(calls, rates), "cost")


@query(
    "j23_positional_pairing",
    """a AS (SELECT event_type AS k, us, event_id, service, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS i FROM ev WHERE event_type IN ('view', 'click'))
SELECT x.i, x.service AS first_service, y.service AS second_service FROM (SELECT * FROM a WHERE k = 'view') x JOIN (SELECT * FROM a WHERE k = 'click') y USING (i)""",
)
def j23(t):
    side = lambda k, n: global_index(t.events.filter(F.col("event_type") == k).select("us", "event_id", F.col("service").alias(n)), ["us", "event_id"], "i").select("i", n)
    return side("view", "first_service").join(side("click", "second_service"), "i")


@query(
    "r26_evenly_sampled_faults",
    """f AS (SELECT ts // 60 AS minute, arg_min(service, {'a': us, 'b': event_id}) AS service FROM ev WHERE event_type = 'error' GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY minute) - 1 AS i, count(*) OVER () AS total FROM f)
SELECT minute, service, i FROM n WHERE i % greatest(1, total // 50) = 0 ORDER BY i LIMIT 50""",
)
def r26(t):
    # a sampling operator: 50 faults spread evenly over all fault minutes
    first = t.events.filter("event_type = 'error'").groupBy(F.expr("ts div 60").alias("minute")).agg(
        F.min_by("service", F.struct("us", "event_id")).alias("service")
    )
    step = F.greatest(F.lit(1), F.floor(first.agg(F.count("*")).scalar() / 50))
    return global_index(first, ["minute"], "i").withColumn("_step", step).filter(
        F.col("i") % F.col("_step") == 0
    ).drop("_step").orderBy("i").limit(50)


# -- event strings and vectors -------------------------------------------------------------------

EVENTS = ERR.rstrip() + """,
me AS (SELECT incident_id, split_part(metric, '_', 1) AS node, split_part(metric, '_', 1) || '&0.0.0.0&' || metric || '&' || CASE WHEN avg(value) > min(m) THEN 'up' ELSE 'down' END AS event
  FROM er JOIN st USING (incident_id, metric) WHERE NOT train GROUP BY incident_id, metric HAVING avg(sqrt(error)) > 1.5),
te AS (SELECT DISTINCT s.incident_id, p.service AS src, s.service AS dst, s.status FROM win_spans s JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id),
tn AS (SELECT incident_id, unnest(list_distinct([src, dst])) AS node, src || '&' || dst || '&call&' || status AS event FROM te),
le AS (SELECT i.incident_id, l.service AS node, l.service || '&' || (('0x' || substr(md5(l.message[:200]), 1, 8))::BIGINT % 10000) AS event FROM logs l JOIN incidents i
  ON l.ts >= i.fault_ts - 1800 AND l.ts <= i.fault_ts + 1800 WHERE contains(l.message, 'ERROR')),
ae AS (SELECT 'metric' AS modality, * FROM me UNION ALL SELECT 'trace', * FROM tn UNION ALL SELECT 'log', * FROM le)
"""


def all_events(t):
    found = detect.direction_events(metric_windows(t), TRAIN, limit=1.5).filter("anomalous")
    service = fusion.service_of(F.col("metric"))
    metric = found.select(
        F.lit("metric").alias("modality"), "incident_id", service.alias("node"),
        eventtext.metric_event(service, F.col("metric"), F.col("direction")).alias("event"),
    )
    calls = win.spans_in_windows(sp.with_parent(t.spans).filter("link = 'child'"), t.fault_windows)
    pairs = calls.select("incident_id", F.col("parent_service").alias("src"), F.col("service").alias("dst"), "status").distinct()
    trace = eventtext.to_both_ends(pairs, NODES).select(
        F.lit("trace").alias("modality"), "incident_id", "node",
        eventtext.trace_event(F.col("src"), F.col("dst"), F.lit("call"), F.col("status")).alias("event"),
    )
    lines = win.spans_in_windows(t.logs.filter(F.col("message").contains("ERROR")), t.fault_windows)
    owner = eventtext.first_owner(F.concat("service", F.lit(".csv")), NODES)
    log = lines.withColumn("node", owner).select(
        F.lit("log").alias("modality"), "incident_id", "node",
        eventtext.log_event(F.col("node"), F.col("message")).alias("event"),
    )
    return metric.unionByName(trace).unionByName(log)


@query("j17_f11_events_to_nodes", EVENTS + "SELECT modality, incident_id, node, event, count(*) AS n FROM ae GROUP BY ALL")
def j17(t):
    return all_events(t).groupBy("modality", "incident_id", "node", "event").agg(F.count("*").alias("n"))


CACHE = """
vx AS (SELECT ['metric', 'trace', 'log'][vec_id % 3 + 1] AS modality, 'svc' || label AS node, label <> 9 AS train, embedding FROM embeddings),
cl AS (SELECT modality, node, i AS pos, round(avg(embedding[i]::DOUBLE), 6) AS m, count(*) AS n FROM vx, range(1, 65) r(i) WHERE train GROUP BY ALL)
"""


def vectors(t):
    modality = F.element_at(F.array(F.lit("metric"), F.lit("trace"), F.lit("log")), (F.col("vec_id") % 3 + 1).cast("int"))
    return t.table("embeddings").select(
        "vec_id", modality.alias("modality"), F.concat(F.lit("svc"), "label").alias("node"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"), (F.col("label") != 9).alias("train"),
    )


@query("a38_embedding_cache", CACHE + "SELECT modality, node, CAST(pos AS INTEGER) AS pos, m AS value, n FROM cl")
def a38(t):
    means = eventtext.mean_vectors(vectors(t).filter("train"), ["modality", "node"])
    cells = means.select("modality", "node", "n", F.posexplode("vector").alias("p", "x"))
    return cells.select("modality", "node", (F.col("p") + 1).alias("pos"), r6("x", "value"), "n")


@query(
    "j18_f12_embedding_lookup",
    EVENTS.rstrip()
    + ","
    + CACHE
    + """,
ne AS (SELECT modality, incident_id, node, count(*) AS n_events FROM ae GROUP BY ALL),
n2 AS (SELECT modality, node, sqrt(sum(m * m)) AS nrm FROM (SELECT modality, node, i, avg(embedding[i]::DOUBLE) AS m FROM vx, range(1, 65) r(i) WHERE train GROUP BY ALL) GROUP BY ALL)
SELECT ne.modality, incident_id, ne.node, n_events, round(nrm * least(ln(1 + n_events), 3), 6) AS norm FROM ne JOIN n2 USING (modality, node)""",
)
def j18(t):
    counts = all_events(t).groupBy("modality", "incident_id", "node").agg(F.count("*").alias("n_events"))
    cache = eventtext.mean_vectors(vectors(t).filter("train"), ["modality", "node"])
    out = eventtext.embedding_lookup(counts, cache)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("modality", "incident_id", "node", "n_events", r6(norm, "norm"))


@query(
    "j21_vocabulary_coverage",
    EVENTS
    + """,
w AS (SELECT DISTINCT modality, unnest(string_split(event, '&')) AS word FROM ae),
kn AS (SELECT DISTINCT modality, unnest(string_split(event, '&')) AS word FROM ae WHERE incident_id < 3000)
SELECT w.modality, count(*) AS n_words, round(avg(CASE WHEN kn.word IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage,
  avg(CASE WHEN kn.word IS NULL THEN 0.0 ELSE 1.0 END) >= CASE w.modality WHEN 'log' THEN 0.4 ELSE 0.6 END AS passes FROM w LEFT JOIN kn USING (modality, word) GROUP BY 1""",
)
def j21(t):
    found = all_events(t)
    # the encoder's vocabulary comes from the earlier incidents
    known = found.filter("incident_id < 3000").select("modality", F.explode(F.split("event", "&")).alias("word"))
    return rounded(eventtext.vocabulary_coverage(found, known), "coverage")


@query("m12_hash_vectors")
def m12(t):
    return eventtext.hash_vectors(all_events(t), ["modality", "incident_id", "node"], 16)


@query(
    "j22_training_rows",
    CACHE
    + """,
nd AS (SELECT DISTINCT incident_id AS index, service AS node FROM win_spans),
lb AS (SELECT incident_id AS index, service AS instance, CASE failure_type WHEN 'error' THEN 'normal' ELSE failure_type END AS anomaly_type, CASE WHEN day >= 19743 THEN 'test' ELSE 'train' END AS data_type FROM incidents),
kn AS (SELECT lb.* FROM lb SEMI JOIN nd ON nd.index = lb.index AND nd.node = lb.instance),
hv AS (SELECT node FROM (SELECT DISTINCT modality, node FROM vx) GROUP BY 1 HAVING count(*) = 3)
SELECT nd.index, nd.node, CAST(nd.node = instance AS INTEGER) AS is_root, CAST(CASE anomaly_type WHEN 'normal' THEN 0 WHEN 'latency' THEN 1 ELSE 2 END AS BIGINT) AS type_no, data_type AS split
FROM nd JOIN kn USING (index) JOIN hv USING (node)""",
)
def j22(t):
    nodes = t.window_spans.select(F.col("incident_id").alias("index"), F.col("service").alias("node")).distinct()
    kind = F.when(F.col("failure_type") == "error", "normal").otherwise(F.col("failure_type"))
    split = F.when(F.col("day") >= 19_743, "test").otherwise("train")
    labels = t.incidents.select(
        F.col("incident_id").alias("index"), F.col("service").alias("instance"), kind.alias("anomaly_type"), split.alias("data_type")
    )
    means = eventtext.mean_vectors(vectors(t), ["modality", "node"]).drop("n")
    per_graph = nodes.join(means, "node")
    return eventtext.training_rows(labels, nodes, per_graph).select("index", "node", "is_root", "type_no", "split")


@query(
    "f15_knowledge_paragraph",
    ERR.rstrip()
    + """,
tot AS (SELECT incident_id, metric, round(sum(error), 6) AS total FROM er WHERE NOT train GROUP BY ALL),
rkd AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY total DESC, metric) AS rank FROM tot),
fl AS (SELECT incident_id, bool_or(anomalous) AS is_anom FROM ss GROUP BY 1),
sv1 AS (SELECT incident_id, split_part(metric, '_', 1) AS s, min(rank) AS r FROM rkd WHERE rank <= 5 GROUP BY ALL),
sv2 AS (SELECT incident_id, string_agg(s, ', ' ORDER BY r) AS svcs FROM sv1 GROUP BY 1)
SELECT incident_id, CASE WHEN is_anom THEN 'The system is in an anomalous state.' ELSE 'The metric correlations are within normal bounds.' END || chr(10) || 'Top metrics: '
  || string_agg('(' || rank || ') ' || metric, ', ' ORDER BY rank) FILTER (rank <= 5) || chr(10) || 'Contribution: '
  || string_agg(metric || ' ' || CAST(CAST(round(CAST(total AS DECIMAL(38,12)), 4) AS DECIMAL(24,4)) AS VARCHAR), ', ' ORDER BY rank) FILTER (rank <= 10) || chr(10) || 'Services: ' || any_value(svcs) AS text
FROM rkd JOIN fl USING (incident_id) JOIN sv2 USING (incident_id) GROUP BY incident_id, is_anom""",
)
def f15(t):
    from faultline.functions.texts import knowledge_paragraph

    err = detect.z_errors(metric_windows(t), TRAIN)
    flags = detect.step_scores(err).groupBy("incident_id").agg(F.bool_or("anomalous").alias("is_anomalous"))
    total = detect.feature_ranking(err).withColumn("total", r6("total"))
    return knowledge_paragraph(total, flags)
