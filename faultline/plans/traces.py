"""Queries on traces: links, call paths, signatures, verdicts and per-service statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.numbers import r6
from faultline.operators import ranking, spans as sp
from faultline.operators.scale import grouped_quantiles
from faultline.plans.registry import query
from faultline.sources.telemetry import SPAN_SERVICES, Telemetry

SERVICES = [f"svc{i}" for i in range(SPAN_SERVICES)]


SELF = """
kids AS (SELECT trace_id, parent_span_id AS span_id, count(*) AS n_children, max(duration) AS max_child
  FROM spans WHERE parent_span_id IS NOT NULL GROUP BY trace_id, parent_span_id),
st AS (SELECT s.*, coalesce(k.n_children, 0) AS n_children,
    s.duration - coalesce(k.max_child, 0.0) AS self_raw,
    greatest(0.0, s.duration - coalesce(k.max_child, 0.0)) AS self_time
  FROM spans s LEFT JOIN kids k USING (trace_id, span_id))
"""

PATHS = """
walk AS (
  SELECT s.trace_id, s.span_id, s.duration, s.ts, s.status, s.service,
    CASE WHEN s.parent_span_id IS NULL THEN 'start' ELSE 'unclear_start' END || '#' || s.service AS call_path,
    1 AS depth
  FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id
  WHERE p.span_id IS NULL
  UNION ALL
  SELECT c.trace_id, c.span_id, c.duration, c.ts, c.status, c.service, w.call_path || '#' || c.service,
    w.depth + 1
  FROM walk w JOIN spans c ON c.trace_id = w.trace_id AND c.parent_span_id = w.span_id)
"""

STV = PATHS + """,
stv AS (SELECT trace_id, call_path, max(CAST(floor(duration) AS BIGINT)) AS rt FROM walk GROUP BY ALL)
"""

# traces with an error status are the abnormal ones, all others the normal pool
SIGNED = STV + """,
bad AS (SELECT trace_id, max(status) AS failed FROM spans GROUP BY trace_id),
sig AS (SELECT trace_id, string_agg(call_path, '|' ORDER BY call_path) AS sig, max(failed) AS failed
  FROM stv JOIN bad USING (trace_id) WHERE rt <> 0 GROUP BY trace_id),"""

FIRST_NORMALS = """
norm AS (SELECT * FROM (SELECT trace_id, sig, row_number() OVER (PARTITION BY sig ORDER BY trace_id) AS pos
  FROM sig WHERE failed = 0) WHERE pos <= 6),"""

ALL_NORMALS = """
norm AS (SELECT trace_id, sig FROM sig WHERE failed = 0),"""

POSITIONS = """
prof AS (SELECT sig, call_path, count(*) AS n_match, avg(rt) AS mean,
    CASE WHEN count(*) > 1 THEN stddev_samp(rt) END AS std
  FROM norm JOIN stv USING (trace_id) WHERE rt <> 0 GROUP BY sig, call_path),
posn AS (SELECT s.trace_id, v.call_path, v.rt, p.n_match, p.mean, p.std,
    coalesce(p.std > 0 AND (v.rt > p.mean + 3 * p.std OR v.rt < p.mean - 3 * p.std), false) AS is_out
  FROM sig s JOIN stv v USING (trace_id) LEFT JOIN prof p ON p.sig = s.sig AND p.call_path = v.call_path
  WHERE s.failed = 1 AND v.rt <> 0)
"""

SPLIT = SIGNED + FIRST_NORMALS + POSITIONS


def split_vectors(t: Telemetry) -> tuple[DataFrame, DataFrame]:
    """Abnormal and normal trace vectors; a trace with a failed span is abnormal."""
    marked = sp.marked_vectors(t.spans)
    return (
        marked.filter(F.col("failed") == 1).drop("failed"),
        marked.filter(F.col("failed") == 0).drop("failed"),
    )


@query(
    "flagship_incident_service_deviation",
    SELF
    + """,
base AS (SELECT service, avg(self_time) AS mean_self, stddev_pop(self_time) AS std_self FROM st GROUP BY service),
w AS (SELECT i.incident_id, i.service AS fault_service, s.service, count(*) AS n, avg(s.self_time) AS win_self
  FROM st s JOIN incidents i ON s.ts >= i.fault_ts - 1800 AND s.ts <= i.fault_ts + 1800 GROUP BY ALL),
d AS (SELECT w.*, round(abs(win_self - mean_self) / greatest(std_self, 1e-6), 6) AS deviation
  FROM w JOIN base USING (service))
SELECT incident_id, fault_service, service, n, round(win_self, 6) AS win_self, deviation,
  row_number() OVER (PARTITION BY incident_id ORDER BY deviation DESC, service) AS rank
FROM d""",
)
def flagship(t: Telemetry) -> DataFrame:
    from faultline.operators.windows import spans_in_windows

    timed = sp.with_self_time(t.spans)
    base = sp.service_self_time(timed).select("service", "mean_self", "std_self")
    window = (
        spans_in_windows(timed, t.fault_windows)
        .groupBy("incident_id", "fault_service", "service")
        .agg(F.count("*").alias("n"), F.avg("self_time").alias("win_self"))
    )
    scored = window.join(base, "service").withColumn(
        "deviation",
        r6(F.abs(F.col("win_self") - F.col("mean_self")) / F.greatest("std_self", F.lit(1e-6))),
    )
    return ranking.rank_within(scored, ["incident_id"], [F.desc("deviation"), "service"]).select(
        "incident_id", "fault_service", "service", "n", r6("win_self", "win_self"), "deviation", "rank"
    )


@query(
    "j6_parent_links",
    """SELECT s.trace_id, s.span_id, s.service, p.service AS parent_service,
  CASE WHEN s.parent_span_id IS NULL THEN 'root' WHEN p.span_id IS NULL THEN 'orphan' ELSE 'child' END AS link
FROM spans s LEFT JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id""",
)
def j6_parent_links(t):
    return sp.with_parent(t.spans).select("trace_id", "span_id", "service", "parent_service", "link")


ROOT_SQL = """SELECT trace_id,
  {expr} AS root_span_id, count(*) AS span_count, min(ts) AS start_ts, max(ts) AS end_ts,
  max(status) AS status FROM spans GROUP BY trace_id"""
LAST_ROOT = "arg_max(span_id, ts * 100 + span_id) FILTER (parent_span_id IS NULL)"


@query(
    "s10_trace_assembly",
    ROOT_SQL.format(expr=f"coalesce({LAST_ROOT}, arg_min(span_id, ts * 100 + span_id))"),
)
def s10_trace_assembly(t):
    return sp.trace_summary(t.spans)


@query("s20_trace_assembly_null_root", ROOT_SQL.format(expr=LAST_ROOT))
def s20_trace_assembly(t):
    return sp.trace_summary(t.spans, fallback_root=False)


@query("g1_call_paths", PATHS + "SELECT trace_id, span_id, call_path, CAST(depth AS BIGINT) AS depth FROM walk")
def g1_call_paths(t):
    return sp.call_paths(t.spans).select("trace_id", "span_id", "call_path", "depth")


@query("g2_self_time_unclipped", SELF + "SELECT trace_id, span_id, n_children, self_raw AS self_time FROM st")
def g2_self_time(t):
    return sp.with_self_time(t.spans, clip=False).select("trace_id", "span_id", "n_children", "self_time")


@query(
    "g2_breadth_first_order",
    PATHS
    + """SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth,
  row_number() OVER (PARTITION BY trace_id, depth ORDER BY ts, span_id) AS pos FROM walk""",
)
def g2_order(t):
    # positions inside one (trace, level); the visiting order is (depth, pos)
    return ranking.rank_within(
        sp.call_paths(t.spans), ["trace_id", "depth"], ["ts", "span_id"], "pos"
    ).select("trace_id", "span_id", "depth", F.col("pos").cast("long").alias("pos"))


@query(
    "a3_service_self_time",
    SELF
    + """SELECT service, count(*) AS n, round(avg(self_time), 6) AS mean_self,
  round(stddev_pop(self_time), 6) AS std_self FROM st GROUP BY service""",
)
def a3_service_self_time(t):
    return sp.service_self_time(sp.with_self_time(t.spans)).select(
        "service", "n", r6("mean_self", "mean_self"), r6("std_self", "std_self")
    )


@query(
    "a4_failed_trace_duration",
    """SELECT service, round(avg(duration), 6) AS mean_duration FROM spans
WHERE trace_id IN (SELECT trace_id FROM spans WHERE status = 1) GROUP BY service""",
)
def a4_failed_trace_duration(t):
    failed = t.spans.groupBy("trace_id").agg(F.max("status").alias("s")).filter("s = 1")
    return (
        t.spans.join(failed, "trace_id", "left_semi")
        .groupBy("service")
        .agg(r6(F.avg("duration"), "mean_duration"))
    )


@query(
    "a5_visited_services",
    "SELECT trace_id, count(DISTINCT service) AS visited FROM spans GROUP BY trace_id",
)
def a5_visited(t):
    return (
        t.spans.select("trace_id", "service").distinct().groupBy("trace_id").agg(F.count("*").alias("visited"))
    )


@query(
    "a6_spectrum",
    """tr AS (SELECT trace_id, max(status) AS failed FROM spans GROUP BY trace_id),
vis AS (SELECT DISTINCT trace_id, service FROM spans),
c AS (SELECT service, CAST(sum(failed) AS BIGINT) AS ef0, CAST(sum(1 - failed) AS BIGINT) AS ep0,
  (SELECT CAST(sum(failed) AS BIGINT) FROM tr) AS total FROM vis JOIN tr USING (trace_id) GROUP BY service),
f AS (SELECT service, ef0, ep0, CASE WHEN ef0 > 0 THEN CAST(ef0 AS DOUBLE) ELSE 0.0001 END AS ef,
  CASE WHEN ep0 > 0 THEN CAST(ep0 AS DOUBLE) ELSE 0.0001 END AS ep,
  CASE WHEN total - ef0 > 0 THEN CAST(total - ef0 AS DOUBLE) ELSE 0.0001 END AS nf FROM c)
SELECT service, ef0, ep0, round(ef / sqrt((ef + ep) * (ef + nf)), 6) AS ochiai FROM f""",
)
def a6_spectrum(t):
    traces = t.spans.groupBy("trace_id").agg(F.max("status").alias("failed"))
    visited = t.spans.select("trace_id", "service").distinct()
    return sp.spectrum(traces, visited).select("service", "ef0", "ep0", r6("ochiai", "ochiai"))


A7_SQL = """
kids AS (SELECT incident_id, trace_id, parent_span_id AS span_id, count(*) AS n_children, max(duration) AS max_child
  FROM win_spans WHERE parent_span_id IS NOT NULL GROUP BY ALL),
st AS (SELECT s.*, coalesce(k.n_children, 0) AS n_children, s.duration - coalesce(k.max_child, 0.0) AS self_time
  FROM win_spans s LEFT JOIN kids k USING (incident_id, trace_id, span_id))
SELECT incident_id, service, round(ln(1 + count(*)), 6) AS log_count,
  round(avg(status), 6) AS error_rate, round(ln(1 + sum(status)), 6) AS log_errors,
  round(ln(1 + avg(duration)), 6) AS log_mean_dur, round(stddev_pop(duration), 6) AS std_dur,
  round(ln(1 + max(duration)), 6) AS log_max_dur, round(ln(1 + avg(greatest(self_time, 0))), 6) AS log_mean_self,
  round(stddev_pop(self_time), 6) AS std_self, round(ln(1 + greatest(max(self_time), 0)), 6) AS log_max_self,
  round(quantile_cont(duration, 0.5), 6) AS median_dur, round(avg(n_children), 6) AS mean_fanout,
  CAST(max(n_children) AS BIGINT) AS max_fanout
FROM st GROUP BY incident_id, service"""


@query("a7_service_trace_features", A7_SQL)
def a7_features(t):
    timed = sp.with_self_time(t.window_spans, ("incident_id", "trace_id"), clip=False)
    keys = ["incident_id", "service"]
    stats = timed.groupBy(*keys).agg(
        r6(F.log1p(F.count("*").cast("double")), "log_count"),
        r6(F.avg("status"), "error_rate"),
        r6(F.log1p(F.sum("status").cast("double")), "log_errors"),
        r6(F.log1p(F.avg("duration")), "log_mean_dur"),
        r6(F.stddev_pop("duration"), "std_dur"),
        r6(F.log1p(F.max("duration")), "log_max_dur"),
        r6(F.log1p(F.avg(F.greatest("self_time", F.lit(0.0)))), "log_mean_self"),
        r6(F.stddev_pop("self_time"), "std_self"),
        r6(F.log1p(F.greatest(F.max("self_time"), F.lit(0.0))), "log_max_self"),
        r6(F.avg("n_children"), "mean_fanout"),
        F.max("n_children").alias("max_fanout"),
    )
    medians = grouped_quantiles(timed, keys, "duration", {"median_dur": 0.5})
    return stats.join(medians, keys).withColumn("median_dur", r6("median_dur"))


@query(
    "a10_service_topology",
    """SELECT DISTINCT p.service AS src, s.service AS dst FROM spans s JOIN spans p
ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id""",
)
def a10_topology(t):
    return sp.service_edges(t.spans)


@query("a11_service_call_vectors", STV + "SELECT trace_id, call_path, rt FROM stv")
def a11_stv(t):
    return sp.stv(sp.call_paths(t.spans))


@query(
    "a12_call_path_dictionary",
    PATHS
    + """SELECT call_path, CAST(row_number() OVER (ORDER BY call_path) - 1 AS BIGINT) AS path_id
FROM (SELECT DISTINCT call_path FROM walk)""",
)
def a12_dictionary(t):
    return sp.call_path_dictionary(sp.call_paths(t.spans))


J11_SQL = STV + """,
bad AS (SELECT trace_id, max(status) AS failed FROM spans GROUP BY trace_id),
dict AS (SELECT call_path, row_number() OVER (ORDER BY call_path) - 1 AS path_id
  FROM (SELECT DISTINCT call_path FROM stv JOIN bad USING (trace_id) WHERE failed = 0)),
j AS (SELECT trace_id, path_id FROM stv LEFT JOIN dict USING (call_path))
SELECT trace_id, count(*) FILTER (path_id IS NULL) = 0 AS valid, count(*) AS n_paths FROM j GROUP BY trace_id"""


@query("j11_call_path_lookup", J11_SQL)
def j11_lookup(t):
    bad, normal = split_vectors(t)
    ids = sp.known_paths(bad.unionByName(normal), sp.call_path_dictionary(normal))
    return sp.valid_traces(ids)


@query(
    "j12_signature_match",
    SPLIT
    + """SELECT s.trace_id, n.trace_id AS normal_trace_id, n.pos FROM sig s JOIN norm n USING (sig) WHERE s.failed = 1""",
)
def j12_match(t):
    return sp.signature_matches(*split_vectors(t)).select(
        "trace_id", "normal_trace_id", F.col("pos").cast("long").alias("pos")
    )


@query(
    "a13_matched_normal_profile",
    SPLIT
    + """SELECT trace_id, call_path, rt, n_match, round(mean, 6) AS mean, round(std, 6) AS std FROM posn""",
)
def a13_profile(t):
    return sp.timeout_positions(*split_vectors(t)).select(
        "trace_id", "call_path", "rt", "n_match", r6("mean", "mean"), r6("std", "std")
    )


VERDICT = """,
ver AS (SELECT trace_id, CAST(coalesce(max(n_match), 0) AS BIGINT) AS n_match,
    CAST(count(*) FILTER (is_out) AS BIGINT) AS n_out,
    greatest(coalesce(max(CASE WHEN is_out THEN (rt - mean) / std / 3 END), 0), 0) AS score
  FROM posn GROUP BY trace_id)
"""


@query(
    "a14_trace_verdicts",
    SIGNED
    + ALL_NORMALS
    + POSITIONS
    + VERDICT
    + """SELECT trace_id, n_match, n_out, round(score, 6) AS score,
  CASE WHEN n_match = 0 THEN 'structural' WHEN n_out > 0 AND score > 2 THEN 'timeout' ELSE 'none' END AS verdict
FROM ver""",
)
def a14_verdicts(t):
    positions = sp.timeout_positions(*split_vectors(t), limit=None)
    return sp.trace_verdicts(positions).withColumn("score", r6("score"))


@query(
    "a15_structural_anomalies",
    SPLIT
    + "SELECT trace_id FROM sig WHERE failed = 1 AND sig NOT IN (SELECT sig FROM norm)",
)
def a15_structural(t):
    bad, normal = split_vectors(t)
    seen = sp.signatures(normal).select(*sp.SIGNATURE).distinct()
    return sp.signatures(bad).join(seen, list(sp.SIGNATURE), "left_anti").select("trace_id")


F4_SQL = SPLIT + VERDICT + """
SELECT v.trace_id,
  CASE WHEN v.n_match = 0 THEN 'structural anomaly, trace ' || v.trace_id
    ELSE 'call timeout, trace ' || v.trace_id || ': ' ||
      (SELECT string_agg(array_to_string(string_split(call_path, '#')[2:], '->') || ' took ' || rt || ' ms, '
         || CASE WHEN rt > mean + 3 * std THEN 'above' ELSE 'below' END || ' the normal limit by '
         || CAST(floor(CASE WHEN rt > mean + 3 * std THEN rt - (mean + 3 * std) ELSE mean - 3 * std - rt END) AS BIGINT)
         || ' ms', '; ' ORDER BY call_path) FROM posn p WHERE p.trace_id = v.trace_id AND p.is_out) END AS description
FROM ver v WHERE n_match = 0 OR (n_out > 0 AND score > 2)"""


@query("f4_trace_descriptions", F4_SQL)
def f4_descriptions(t):
    from faultline.functions.texts import trace_descriptions

    return trace_descriptions(sp.timeout_positions(*split_vectors(t)))


A16_COLS = ", ".join(
    f"coalesce(max({f}) FILTER (service = 'svc{i}'), 0)::DOUBLE AS svc{i}_{f}"
    for i in range(SPAN_SERVICES)
    for f in ("duration", "status", "self_time")
)


@query(
    "a16_trace_vectors",
    PATHS.rstrip()
    + ","
    + SELF
    + f""",
l AS (SELECT w.trace_id, w.service, w.duration, w.status, s.self_raw AS self_time,
    row_number() OVER (PARTITION BY w.trace_id, w.service ORDER BY w.depth DESC, w.ts DESC, w.span_id DESC) AS rn
  FROM walk w JOIN st s USING (trace_id, span_id))
SELECT trace_id, CAST(10 AS BIGINT) AS n_services, count(*) AS visited, {A16_COLS}
FROM l WHERE rn = 1 GROUP BY trace_id""",
)
def a16_vectors(t):
    return sp.trace_vectors(sp.timed_paths(t.spans), SERVICES)


@query(
    "j19_fault_service_in_trace",
    """SELECT DISTINCT incident_id, trace_id, fault_service FROM win_spans WHERE service = fault_service""",
)
def j19_fault_service(t):
    return (
        t.window_spans.filter(F.col("service") == F.col("fault_service"))
        .select("incident_id", "trace_id", "fault_service")
        .distinct()
    )


@query(
    "p17_flat_spans",
    """SELECT trace_id, span_id, parent_span_id, service, duration,
  strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start_time, status AS anomaly FROM spans""",
)
def p17_flat(t):
    start = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss")
    return t.spans.select(
        "trace_id", "span_id", "parent_span_id", "service", "duration",
        start.alias("start_time"), F.col("status").alias("anomaly"),
    )


@query(
    "r21_normal_trace_cap",
    """SELECT trace_id FROM (SELECT trace_id, max(status) AS failed FROM spans GROUP BY trace_id)
WHERE failed = 0 ORDER BY trace_id LIMIT 500""",
)
def r21_cap(t):
    # the cap of 500 normal traces is the feature itself
    ok = t.spans.groupBy("trace_id").agg(F.max("status").alias("f")).filter("f = 0")
    return ok.select("trace_id").orderBy("trace_id").limit(500)


@query(
    "p13_minimum_traces",
    """SELECT incident_id, count(DISTINCT trace_id) AS n_traces FROM win_spans GROUP BY incident_id
HAVING count(DISTINCT trace_id) > 10""",
)
def p13_minimum(t):
    return (
        t.window_spans.select("incident_id", "trace_id")
        .distinct()
        .groupBy("incident_id")
        .agg(F.count("*").alias("n_traces"))
        .filter("n_traces > 10")
    )
