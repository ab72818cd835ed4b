"""Queries on causal links, walks and service graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.numbers import r6
from faultline.operators import causal, graphs, ranking
from faultline.operators import spans as sp
from faultline.operators import windows as win
from faultline.plans.registry import query
from faultline.plans.scores import ETA, eta_channels, window_eta
from faultline.plans.windows import MW, metric_windows
from faultline.session import cut_lineage

ENTRY_SERVICE = "svc0"

LINKS = """
lg AS (SELECT a.incident_id, a.metric AS src, b.metric AS dst, b.k - a.k AS lag, a.value AS x, b.value AS y, c.value AS z
  FROM mw a JOIN mw b ON a.incident_id = b.incident_id AND b.k - a.k BETWEEN 1 AND 10 AND a.metric <> b.metric
  JOIN mw c ON c.incident_id = b.incident_id AND c.metric = b.metric AND c.k = b.k - 1),
lc AS (SELECT incident_id, src, dst, lag, count(*) AS n, corr(x, y) AS r, corr(x, z) AS rxz, corr(z, y) AS rzy FROM lg GROUP BY ALL),
lp AS (SELECT *, (r - rxz * rzy) / sqrt((1 - rxz * rxz) * (1 - rzy * rzy)) AS pr FROM lc),
links AS (SELECT incident_id, src, dst, lag, r, pr FROM lp
  WHERE abs(0.5 * ln((1 + r) / (1 - r))) * sqrt(n - 3) > 1.959964 AND abs(0.5 * ln((1 + pr) / (1 - pr))) * sqrt(n - 4) > 1.959964)
"""


def links(t):
    return causal.lagged_links(metric_windows(t))


def entries(t):
    """The metric with the largest eta is where an incident's walk starts."""
    return ranking.rank_within(
        window_eta(t).withColumn("eta", r6("eta")), ["incident_id"], [F.desc("eta"), "metric"]
    ).filter("rank = 1").select("incident_id", F.col("metric").alias("entry"))


@query(
    "w23_correlation_matrix",
    MW
    + """SELECT a.incident_id, a.metric AS a, b.metric AS b,
  round(CASE WHEN a.metric = b.metric THEN 0.0 ELSE coalesce(corr(a.value, b.value), 0.0) END, 6) AS r
FROM mw a JOIN mw b ON a.incident_id = b.incident_id AND a.k = b.k GROUP BY a.incident_id, a.metric, b.metric""",
)
def w23(t):
    return causal.correlations(metric_windows(t)).withColumn("r", r6("r"))


@query(
    "w21_lagged_links",
    MW.rstrip() + "," + LINKS + "SELECT incident_id, src, dst, lag, round(r, 6) AS r, round(pr, 6) AS partial FROM links",
)
def w21(t):
    return links(t).select("incident_id", "src", "dst", "lag", r6("r", "r"), r6("partial", "partial"))


@query(
    "w21_lagged_links_as_coded",
    MW.rstrip()
    + ","
    + LINKS
    + """,
o AS (SELECT incident_id, metric, row_number() OVER (PARTITION BY incident_id ORDER BY metric) AS pos FROM (SELECT DISTINCT incident_id, metric FROM mw))
SELECT links.incident_id, dst AS src, src AS dst, lag FROM links JOIN o ON o.incident_id = links.incident_id AND o.metric = links.dst WHERE pos <= 33""",
)
def w21_as_coded(t):
    # the reversed direction, with only the first 33 metrics as targets
    found = causal.lagged_links(metric_windows(t), as_coded=True, first_targets=33)
    return found.select("incident_id", "src", "dst", "lag")


# conditions searched up to order 2: ties by name and lag, strength is the smallest absolute value so far
SEARCH = """
lv AS MATERIALIZED (SELECT a.incident_id, a.metric, g.lag, a.k + g.lag AS k, a.value AS v FROM mw a, range(0, 11) g(lag) WHERE a.k + g.lag BETWEEN 10 AND 29),
c0 AS MATERIALIZED (SELECT x.incident_id, y.metric AS dst, x.metric AS src, x.lag, corr(x.v, y.v) AS r FROM lv x JOIN lv y
  ON y.incident_id = x.incident_id AND y.k = x.k AND y.lag = 0 WHERE x.lag > 0 GROUP BY ALL),
o0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY incident_id, dst ORDER BY abs(r) DESC, src, lag) AS pos,
    count(*) OVER (PARTITION BY incident_id, dst) AS parents
  FROM c0 WHERE abs(0.5 * ln((1 + r) / (1 - r))) * sqrt(17) > 1.959964),
n1 AS MATERIALIZED (SELECT p.*, s.src AS s_src, s.lag AS s_lag, s.r AS rys FROM o0 p LEFT JOIN o0 s
  ON s.incident_id = p.incident_id AND s.dst = p.dst AND s.pos = CASE WHEN p.pos = 1 THEN 2 ELSE 1 END),
d1 AS MATERIALIZED (SELECT n.incident_id, n.dst, n.src, n.lag, corr(x.v, z.v) AS rps FROM n1 n JOIN lv x ON x.incident_id = n.incident_id AND x.metric = n.src AND x.lag = n.lag
  JOIN lv z ON z.incident_id = n.incident_id AND z.metric = n.s_src AND z.lag = n.s_lag AND z.k = x.k GROUP BY ALL),
t1 AS (SELECT n1.*, (r - rps * rys) / sqrt((1 - rps * rps) * (1 - rys * rys)) AS r1 FROM n1 LEFT JOIN d1 USING (incident_id, dst, src, lag)),
o1 AS MATERIALIZED (SELECT incident_id, dst, src, lag, r, CASE WHEN parents > 1 THEN r1 ELSE r END AS partial, CASE WHEN parents > 1 THEN 1 ELSE 0 END AS n_conditions,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY incident_id, dst) AS parents
  FROM t1 WHERE parents = 1 OR abs(0.5 * ln((1 + r1) / (1 - r1))) * sqrt(16) > 1.959964
  WINDOW w AS (PARTITION BY incident_id, dst ORDER BY CASE WHEN parents > 1 THEN least(abs(r), abs(r1)) ELSE abs(r) END DESC, src, lag)),
n2 AS MATERIALIZED (SELECT p.*, s.src AS s_src, s.lag AS s_lag, s.r AS rys, u.src AS u_src, u.lag AS u_lag, u.r AS ryu FROM o1 p
  JOIN o1 s ON s.incident_id = p.incident_id AND s.dst = p.dst AND s.pos = CASE WHEN p.pos = 1 THEN 2 ELSE 1 END
  JOIN o1 u ON u.incident_id = p.incident_id AND u.dst = p.dst AND u.pos = CASE WHEN p.pos <= 2 THEN 3 ELSE 2 END),
two AS MATERIALIZED (SELECT incident_id, dst, src, lag, 'ps' AS kind, src AS m1, lag AS l1, s_src AS m2, s_lag AS l2 FROM n2
  UNION ALL SELECT incident_id, dst, src, lag, 'pu', src, lag, u_src, u_lag FROM n2
  UNION ALL SELECT incident_id, dst, src, lag, 'su', s_src, s_lag, u_src, u_lag FROM n2),
rr AS MATERIALIZED (SELECT t.incident_id, dst, src, t.lag, kind, corr(x.v, z.v) AS r FROM two t JOIN lv x ON x.incident_id = t.incident_id AND x.metric = m1 AND x.lag = l1
  JOIN lv z ON z.incident_id = t.incident_id AND z.metric = m2 AND z.lag = l2 AND z.k = x.k GROUP BY ALL),
d2 AS MATERIALIZED (SELECT incident_id, dst, src, lag, min(r) FILTER (kind = 'ps') AS rps, min(r) FILTER (kind = 'pu') AS rpu, min(r) FILTER (kind = 'su') AS rsu
  FROM rr GROUP BY ALL),
e2 AS (SELECT *, (r - rps * rys) / sqrt((1 - rps * rps) * (1 - rys * rys)) AS a, (rpu - rps * rsu) / sqrt((1 - rps * rps) * (1 - rsu * rsu)) AS b,
    (ryu - rys * rsu) / sqrt((1 - rys * rys) * (1 - rsu * rsu)) AS c FROM n2 JOIN d2 USING (incident_id, dst, src, lag)),
t2 AS (SELECT *, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS r2 FROM e2),
searched AS (SELECT incident_id, src, dst, lag, r2 AS partial, 2 AS n_conditions FROM t2 WHERE abs(0.5 * ln((1 + r2) / (1 - r2))) * sqrt(15) > 1.959964
  UNION ALL SELECT incident_id, src, dst, lag, partial, n_conditions FROM o1 WHERE parents <= 2)
"""


@query(
    "w21_condition_sets_order_2",
    MW.rstrip() + "," + SEARCH + "SELECT incident_id, src, dst, lag, round(partial, 6) AS partial, CAST(n_conditions AS BIGINT) AS n_conditions FROM searched WHERE src <> dst",
)
def w21_search(t):
    return causal.condition_set_links(metric_windows(t), max_order=2).withColumn("partial", r6("partial"))


@query("w21_condition_sets")
def w21_full_search(t):
    return causal.condition_set_links(metric_windows(t))


HEAD = ETA.rstrip() + "," + LINKS.rstrip() + """,
ent AS (SELECT incident_id, metric AS entry FROM (SELECT incident_id, metric, row_number() OVER (PARTITION BY incident_id
    ORDER BY round(eta, 6) DESC, metric) AS rn FROM eta) WHERE rn = 1),
ed AS (SELECT DISTINCT incident_id, src, dst FROM links),
"""
PLAIN = """wt AS (SELECT a.incident_id, b.metric AS node, CASE WHEN b.metric = e.entry THEN 0.0 ELSE coalesce(abs(corr(a.value, b.value)), 0.0) END AS w
  FROM ent e JOIN mw a ON a.incident_id = e.incident_id AND a.metric = e.entry JOIN mw b ON b.incident_id = a.incident_id AND b.k = a.k
  GROUP BY a.incident_id, b.metric, e.entry),
"""
MOVES = """q AS (
  SELECT ed.incident_id, ed.dst AS src, ed.src AS dst, w FROM ed JOIN wt ON wt.incident_id = ed.incident_id AND wt.node = ed.src
  UNION ALL
  SELECT ed.incident_id, ed.src, ed.dst, 0.2 * w FROM ed JOIN wt ON wt.incident_id = ed.incident_id AND wt.node = ed.dst
    WHERE NOT EXISTS (SELECT 1 FROM ed r WHERE r.incident_id = ed.incident_id AND r.src = ed.dst AND r.dst = ed.src)
  UNION ALL
  SELECT wt.incident_id, node, node, greatest(0.0, w - coalesce((SELECT max(p.w) FROM ed JOIN wt p ON p.incident_id = ed.incident_id AND p.node = ed.src
      WHERE ed.incident_id = wt.incident_id AND ed.dst = wt.node), 0.0)) FROM wt),
tm AS (SELECT incident_id, src, dst, w / sum(w) OVER (PARTITION BY incident_id, src) AS p FROM q WHERE w > 0)
"""

WALK = HEAD + PLAIN + MOVES


def _taken_out_sql() -> str:
    """CTEs p5 ... p0: correlations of x (the entry), y (the node) and the covariates 1-5, less one covariate each."""
    out = [
        """mem AS (SELECT incident_id, node, 'x' AS v, entry AS metric FROM nd
  UNION ALL SELECT incident_id, node, 'y', node FROM nd UNION ALL SELECT incident_id, node, CAST(rank AS VARCHAR), cov FROM pk WHERE rank <= 5),
p5 AS (SELECT i.incident_id, i.node, i.v AS a, j.v AS b, min(c.r) AS r FROM mem i JOIN mem j ON j.incident_id = i.incident_id AND j.node = i.node AND i.v <> j.v
  JOIN cm c ON c.incident_id = i.incident_id AND c.a = i.metric AND c.b = j.metric GROUP BY ALL)"""
    ]
    for s in range(5, 0, -1):
        out.append(f"""p{s - 1} AS (SELECT p.incident_id, p.node, p.a, p.b, CASE WHEN s.r IS NULL OR u.r IS NULL THEN p.r
  WHEN 1 - s.r * s.r > 1e-10 AND 1 - u.r * u.r > 1e-10 THEN (p.r - s.r * u.r) / sqrt((1 - s.r * s.r) * (1 - u.r * u.r)) END AS r
  FROM p{s} p LEFT JOIN p{s} s ON s.incident_id = p.incident_id AND s.node = p.node AND s.a = p.a AND s.b = '{s}'
  LEFT JOIN p{s} u ON u.incident_id = p.incident_id AND u.node = p.node AND u.a = p.b AND u.b = '{s}' WHERE p.a <> '{s}' AND p.b <> '{s}')""")
    return ",\n".join(out)


PARTIAL = (
    """cm AS (SELECT a.incident_id, a.metric AS a, b.metric AS b, corr(a.value, b.value) AS r FROM mw a JOIN mw b
  ON a.incident_id = b.incident_id AND a.k = b.k AND a.metric <> b.metric GROUP BY ALL),
nd AS (SELECT DISTINCT mw.incident_id, mw.metric AS node, entry FROM mw JOIN ent USING (incident_id)),
gv AS (SELECT nd.incident_id, node, entry, src AS cov FROM nd JOIN ed ON ed.incident_id = nd.incident_id AND ed.dst = nd.entry
  UNION SELECT nd.incident_id, node, entry, src FROM nd JOIN ed ON ed.incident_id = nd.incident_id AND ed.dst = nd.node),
pk AS (SELECT gv.incident_id, node, cov, row_number() OVER (PARTITION BY gv.incident_id, node ORDER BY abs(r) DESC, cov) AS rank
  FROM gv JOIN cm ON cm.incident_id = gv.incident_id AND cm.a = cov AND cm.b = node WHERE cov <> node AND cov <> entry),
"""
    + _taken_out_sql()
    + """,
wt AS (SELECT nd.incident_id, nd.node, CASE WHEN nd.node = entry THEN 0.0 ELSE coalesce(least(abs(r), 1.0), 0.0) END AS w
  FROM nd LEFT JOIN p0 ON p0.incident_id = nd.incident_id AND p0.node = nd.node AND a = 'x' AND b = 'y'),
"""
)


def plain_transition(t):
    return causal.transition(metric_windows(t), links(t), entries(t), partial=False)


@query(
    "w24_transition_plain",
    WALK + "SELECT incident_id, src, dst, round(p, 6) AS p FROM tm",
)
def w24(t):
    return plain_transition(t).withColumn("p", r6("p"))


@query("g3_transition_partial", HEAD + PARTIAL + MOVES + "SELECT incident_id, src, dst, round(p, 6) AS p FROM tm")
def g3(t):
    return causal.transition(metric_windows(t), links(t), entries(t)).withColumn("p", r6("p"))


STEPS = "".join(
    f""",
m{i} AS (SELECT m.incident_id, tm.dst AS node, sum(m.mass * tm.p) AS mass FROM m{i - 1} m JOIN tm
  ON tm.incident_id = m.incident_id AND tm.src = m.node GROUP BY m.incident_id, tm.dst)"""
    for i in range(1, 16)
)
VISITS = (
    WALK.rstrip()
    + ",\nm0 AS (SELECT incident_id, entry AS node, 1000.0::DOUBLE AS mass FROM ent)"
    + STEPS
    + ",\nvis AS (SELECT incident_id, node, sum(mass) AS visits FROM ("
    + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(1, 16))
    + ") GROUP BY incident_id, node)\n"
)


def visits(t):
    return causal.expected_visits(plain_transition(t), entries(t))


@query("g4_walk_visits", VISITS + "SELECT incident_id, node, round(visits, 6) AS visits FROM vis")
def g4(t):
    return visits(t).withColumn("visits", r6("visits"))


GAMMA = VISITS + """,
gm AS (SELECT eta.incident_id, eta.metric, eta, coalesce(
    0.5 * coalesce(visits, 0.0) / nullif(max(visits) OVER w, 0) + 0.5 * eta / nullif(max(eta) OVER w, 0), abs(eta)) AS gamma
  FROM eta LEFT JOIN vis ON vis.incident_id = eta.incident_id AND vis.node = eta.metric WINDOW w AS (PARTITION BY eta.incident_id))
"""


@query("r1_gamma", GAMMA + "SELECT incident_id, metric, round(gamma, 6) AS gamma FROM gm")
def r1(t):
    return causal.gamma(visits(t), window_eta(t)).select("incident_id", "metric", r6("gamma", "gamma"))


@query(
    "g6_propagation_paths",
    MW.rstrip()
    + ","
    + LINKS
    + """,
e AS (SELECT DISTINCT incident_id, src, dst FROM links),
deg AS (SELECT incident_id, src AS metric, count(*) AS d FROM e GROUP BY ALL),
s0 AS (SELECT * FROM (SELECT incident_id, metric, row_number() OVER (PARTITION BY incident_id ORDER BY d DESC, metric) AS sr FROM deg) WHERE sr <= 3),
p1 AS (SELECT s0.incident_id, sr, dst AS node, min(metric || ' → ' || dst) AS path FROM s0 JOIN e ON e.incident_id = s0.incident_id AND e.src = s0.metric GROUP BY ALL),
p2 AS (SELECT p1.incident_id, sr, dst AS node, min(path || ' → ' || dst) AS path FROM p1 JOIN e ON e.incident_id = p1.incident_id AND e.src = p1.node
  WHERE NOT EXISTS (SELECT 1 FROM p1 v WHERE v.incident_id = p1.incident_id AND v.sr = p1.sr AND v.node = e.dst)
  AND NOT EXISTS (SELECT 1 FROM s0 v WHERE v.incident_id = p1.incident_id AND v.sr = p1.sr AND v.metric = e.dst) GROUP BY ALL),
p3 AS (SELECT p2.incident_id, sr, dst AS node, min(path || ' → ' || dst) AS path FROM p2 JOIN e ON e.incident_id = p2.incident_id AND e.src = p2.node
  WHERE NOT EXISTS (SELECT 1 FROM p1 v WHERE v.incident_id = p2.incident_id AND v.sr = p2.sr AND v.node = e.dst)
  AND NOT EXISTS (SELECT 1 FROM p2 v WHERE v.incident_id = p2.incident_id AND v.sr = p2.sr AND v.node = e.dst)
  AND NOT EXISTS (SELECT 1 FROM s0 v WHERE v.incident_id = p2.incident_id AND v.sr = p2.sr AND v.metric = e.dst) GROUP BY ALL),
al AS (SELECT *, 1 AS depth FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3)
SELECT incident_id, pos, path FROM (SELECT incident_id, path, row_number() OVER (PARTITION BY incident_id ORDER BY sr, depth, path) AS pos FROM al) WHERE pos <= 5""",
)
def g6(t):
    found = cut_lineage(links(t))
    degree = (
        found.select("incident_id", "src", "dst").distinct()
        .groupBy("incident_id", F.col("src").alias("metric")).agg(F.count("*").alias("d"))
    )
    sources = ranking.rank_within(
        degree, ["incident_id"], [F.desc("d"), "metric"], "source_rank"
    ).filter("source_rank <= 3")
    return causal.propagation_paths(found, sources).select(
        "incident_id", F.col("pos").cast("long").alias("pos"), "path"
    )


@query(
    "g10_graph_size",
    MW.rstrip()
    + ","
    + LINKS
    + """,
e AS (SELECT DISTINCT incident_id, src, dst FROM links),
nd AS (SELECT incident_id, count(DISTINCT n) AS n_nodes FROM (SELECT incident_id, src AS n FROM e UNION ALL SELECT incident_id, dst FROM e) GROUP BY 1)
SELECT incident_id, count(*) AS n_edges, min(n_nodes) AS n_nodes, round(count(*) / greatest(min(n_nodes), 1), 6) AS density
FROM e JOIN nd USING (incident_id) GROUP BY 1""",
)
def g10(t):
    return causal.graph_size(links(t)).withColumn("density", r6("density"))


CORR_SQL = """
kids AS (SELECT trace_id, parent_span_id AS span_id, max(duration) AS max_child FROM spans WHERE parent_span_id IS NOT NULL GROUP BY ALL),
st AS (SELECT s.incident_id, s.trace_id, s.service, s.ts, s.span_id, s.duration - coalesce(k.max_child, 0.0) AS self_time
  FROM win_spans s LEFT JOIN kids k USING (trace_id, span_id)),
pt AS (SELECT incident_id, trace_id, service, arg_max(self_time, ts) AS y FROM st GROUP BY ALL),
nn AS (SELECT incident_id, count(DISTINCT trace_id) AS n FROM pt GROUP BY 1),
fr AS (SELECT incident_id, trace_id, y AS x FROM pt WHERE service = 'svc0'),
fs AS (SELECT incident_id, sum(x) AS sx, sum(x * x) AS sxx FROM fr GROUP BY 1),
ot AS (SELECT pt.incident_id, service, sum(y) AS sy, sum(y * y) AS syy, coalesce(sum(x * y), 0.0) AS sxy FROM pt LEFT JOIN fr USING (incident_id, trace_id)
  WHERE service <> 'svc0' GROUP BY ALL)
SELECT incident_id, service, round(CASE WHEN n = 1 THEN 1.0 WHEN n * sxx - sx * sx > 1e-6 AND n * syy - sy * sy > 1e-6
  THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0.0 END, 6) AS r
FROM ot JOIN nn USING (incident_id) JOIN fs USING (incident_id)"""


def self_time_correlation(t):
    timed = sp.with_self_time(t.spans, clip=False)
    rows = win.spans_in_windows(timed, t.fault_windows)
    last = F.max_by("self_time", "ts").alias("self_time")
    per_trace = rows.groupBy("incident_id", "trace_id", "service").agg(last)
    return causal.service_correlation(per_trace, ENTRY_SERVICE)


@query("g5_self_time_correlation", CORR_SQL)
def g5_corr(t):
    return self_time_correlation(t).withColumn("r", r6("r"))


ROUNDS = ",\n".join(
    f"""x{i} AS (SELECT n.incident_id, n.service, 0.5 * CASE WHEN n.service = 'svc0' THEN 0.0 ELSE n.r END + 0.5 * coalesce(s.part, 0.0) AS score
  FROM node n LEFT JOIN (SELECT w.incident_id, w.src, sum(w.w * x.score) AS part FROM arcs w JOIN x{i - 1} x
    ON x.incident_id = w.incident_id AND x.service = w.dst GROUP BY ALL) s ON s.incident_id = n.incident_id AND s.src = n.service)"""
    for i in range(1, 51)
)
POWER = (
    "cr AS MATERIALIZED (WITH "
    + CORR_SQL.strip()
    + """),
node AS MATERIALIZED (SELECT * FROM cr UNION ALL SELECT DISTINCT incident_id, 'svc0', -1.0 FROM cr),
calls AS MATERIALIZED (SELECT DISTINCT s.incident_id, p.service AS src, s.service AS dst, a.r AS r_src, b.r AS r_dst FROM win_spans s
  JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id
  JOIN node a ON a.incident_id = s.incident_id AND a.service = p.service JOIN node b ON b.incident_id = s.incident_id AND b.service = s.service
  WHERE p.service <> s.service),
raw AS (SELECT incident_id, src, dst, r_dst AS w FROM calls
  UNION ALL SELECT incident_id, dst, src, 0.5 * r_src FROM calls c WHERE src <> 'svc0' AND NOT EXISTS
    (SELECT 1 FROM calls d WHERE d.incident_id = c.incident_id AND d.src = c.dst AND d.dst = c.src)
  UNION ALL SELECT incident_id, service, service, greatest(0.0, r - coalesce((SELECT max(r_dst) FROM calls c
    WHERE c.incident_id = n.incident_id AND c.src = n.service), 0.0)) FROM node n WHERE service <> 'svc0'),
arcs AS MATERIALIZED (SELECT incident_id, src, dst, w / total AS w FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY incident_id, src) AS total FROM raw) WHERE total > 1e-9),
x0 AS (SELECT incident_id, service, 0.0 AS score FROM node),
"""
    + ROUNDS.replace("AS (SELECT n.", "AS MATERIALIZED (SELECT n.")
)


@query("g5_service_power_iteration", POWER + " SELECT incident_id, service, round(score, 6) AS score FROM x50")
def g5(t):
    edges = win.spans_in_windows(sp.with_parent(t.spans).filter("link = 'child'"), t.fault_windows)
    pairs = edges.select("incident_id", F.col("parent_service").alias("src"), F.col("service").alias("dst")).distinct()
    rounded = cut_lineage(self_time_correlation(t).withColumn("r", r6("r")))  # sums of weights near 0 must not hang on the order of rows
    return causal.service_walk(pairs, rounded, ENTRY_SERVICE).withColumn("score", r6("score"))


@query(
    "r20_priority_pruning",
    MW
    + """SELECT incident_id, metric, pos FROM (SELECT incident_id, metric, row_number() OVER (PARTITION BY incident_id
  ORDER BY CASE WHEN kpi = 'error' THEN 0 ELSE 1 END, metric) AS pos FROM (SELECT DISTINCT incident_id, metric, kpi FROM mw)) WHERE pos <= 120""",
)
def r20(t):
    names = metric_windows(t).select("incident_id", "metric", "kpi").distinct()
    return causal.prune_metrics(names, F.col("kpi") == "error").select(
        "incident_id", "metric", F.col("pos").cast("long").alias("pos")
    )


# service graph of every incident window, with each node's features
GRAPH = """
gn AS (SELECT incident_id, service AS node, count(*) AS n, round(avg(duration), 6) AS f1, CAST(max(status) AS DOUBLE) AS f2 FROM win_spans GROUP BY ALL),
ge AS (SELECT DISTINCT s.incident_id, p.service AS src, s.service AS dst FROM win_spans s JOIN spans p
  ON p.trace_id = s.trace_id AND p.span_id = s.parent_span_id JOIN gn ON gn.incident_id = s.incident_id AND gn.node = p.service)
"""


def service_graph(t):
    nodes = t.window_spans.groupBy("incident_id", F.col("service").alias("node")).agg(
        F.count("*").alias("n"),
        r6(F.avg("duration"), "f1"),
        F.max("status").cast("double").alias("f2"),
    )
    linked = win.spans_in_windows(sp.with_parent(t.spans).filter("link = 'child'"), t.fault_windows)
    edges = linked.select("incident_id", F.col("parent_service").alias("src"), F.col("service").alias("dst")).distinct()
    return nodes, graphs.inside(edges, nodes)


@query(
    "g7_self_loops",
    GRAPH + "SELECT * FROM ge UNION ALL SELECT incident_id, node, node FROM gn WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.incident_id = gn.incident_id AND ge.dst = gn.node)",
)
def g7(t):
    nodes, edges = service_graph(t)
    return graphs.add_self_loops(nodes, edges)


@query(
    "g8_neighbour_mean",
    GRAPH
    + """SELECT gn.incident_id, gn.node, min(gn.f1) AS f1, min(gn.f2) AS f2, round(coalesce(sum(s.f1), 0) / greatest(count(s.node), 1), 6) AS nf1,
  round(coalesce(sum(s.f2), 0) / greatest(count(s.node), 1), 6) AS nf2
FROM gn LEFT JOIN ge ON ge.incident_id = gn.incident_id AND ge.dst = gn.node
LEFT JOIN gn s ON s.incident_id = ge.incident_id AND s.node = ge.src GROUP BY gn.incident_id, gn.node""",
)
def g8(t):
    nodes, edges = service_graph(t)
    out = graphs.neighbour_mean(nodes, edges, ["f1", "f2"])
    return out.select("incident_id", "node", "f1", "f2", r6("nf1", "nf1"), r6("nf2", "nf2"))


@query("g9_drop_nodes")
def g9(t):
    nodes, edges = service_graph(t)
    roots = t.incidents.select("incident_id", F.col("service").alias("root"))
    kept, inner = graphs.drop_nodes(nodes, edges, roots)
    return inner.join(kept.groupBy("incident_id").agg(F.count("*").alias("n_nodes")), "incident_id")


@query(
    "g11_batch_offsets",
    GRAPH
    + """,
sz AS (SELECT incident_id, count(*) AS n FROM gn GROUP BY 1),
off AS (SELECT incident_id, CAST(coalesce(sum(n) OVER (ORDER BY incident_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS node_offset FROM sz)
SELECT gn.incident_id, node, row_number() OVER (PARTITION BY gn.incident_id ORDER BY node) - 1 + node_offset AS node_id FROM gn JOIN off USING (incident_id)""",
)
def g11(t):
    nodes, _ = service_graph(t)
    return graphs.batch_ids(nodes).select("incident_id", "node", "node_id")
