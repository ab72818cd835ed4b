"""Queries on anomaly scores of the 30-point metric windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.numbers import fixed_sql, r6
from faultline.operators import detect, patterns, ranking
from faultline.operators import series as se
from faultline.plans.registry import query
from faultline.plans.series import SHAPE
from faultline.plans.windows import MW, metric_windows

TRAIN = "k < 15"  # the first half of a window calibrates

BASE = "base AS (SELECT metric, avg(value) AS base_mean, stddev_pop(value) AS base_std FROM metrics GROUP BY metric)"

CLASSED = SHAPE.rstrip() + ",\n" + BASE + """,
tr AS (SELECT *, (last - first) / nullif(vmax - vmin, 0) AS trend, (post_mean - pre_mean) / nullif(vstd, 0) AS shift, max_step / nullif(vmax - vmin, 0) AS jump FROM sh),
cl AS (SELECT *, CAST(CASE WHEN abs(shift) >= 1.2 AND jump >= 0.5 THEN CASE WHEN shift > 0 THEN 0 ELSE 1 END
  WHEN trend >= 0.8 THEN 2 WHEN trend <= -0.8 THEN 3
  WHEN n_high = 1 AND n_low = 0 THEN 4 WHEN n_low = 1 AND n_high = 0 THEN 5
  WHEN n_high > n_low AND high_span = n_high - 1 THEN 6 WHEN n_low > n_high AND low_span = n_low - 1 THEN 7
  WHEN n_high > n_low THEN 8 WHEN n_low > n_high THEN 9 ELSE 10 END AS BIGINT) AS class_no FROM tr),
sc AS (SELECT * FROM (SELECT cl.*, base_mean, base_std, CAST(round(CAST(abs((CASE WHEN class_no % 2 = 0 THEN vmax ELSE vmin END - base_mean)
    / CASE WHEN base_std = 0 THEN 1e-6 ELSE base_std END) / 2 AS DECIMAL(38,12)), 2) AS DOUBLE) AS score
  FROM cl JOIN base USING (metric)) WHERE score > 1),
sv AS (SELECT *, CASE WHEN score >= 5 THEN 'critical' WHEN score >= 3 THEN 'severe' WHEN score >= 2 THEN 'moderate' ELSE 'mild' END AS severity FROM sc)
"""


def window_shapes(t):
    facts = t.metrics.groupBy("metric").agg(
        F.avg("value").alias("base_mean"), F.stddev_pop("value").alias("base_std")
    )
    names = t.metrics.select("metric", "service", "kpi").distinct()
    windows = metric_windows(t)
    span = windows.groupBy("incident_id", "metric").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )
    shapes = se.shape(windows, ["incident_id", "metric"])
    return (
        shapes.join(span, ["incident_id", "metric"]).join(facts, "metric").join(names, "metric")
    )


@query(
    "m7_pattern_classes",
    CLASSED + "SELECT incident_id, metric, class_no FROM cl",
)
def m7_rules(t):
    return window_shapes(t).select("incident_id", "metric", patterns.pattern_class().alias("class_no"))


@query(
    "w15_deviation_severity",
    CLASSED + "SELECT incident_id, metric, class_no, score, severity FROM sv",
)
def w15(t):
    return patterns.deviation_scores(window_shapes(t)).select(
        "incident_id", "metric", "class_no", "score", "severity"
    )


def _template_sql() -> str:
    names = {
        "kpi": "kpi", "service": "service", "minutes": "CAST(minutes AS VARCHAR)",
        "start": "start", "peaks": "CAST(peaks AS VARCHAR)", "dips": "CAST(dips AS VARCHAR)",
        "shift_pct": fixed_sql("sgn * CASE WHEN abs(pre_mean) > 1e-10 THEN (post_mean - pre_mean) / abs(pre_mean) * 100 ELSE (post_mean - pre_mean) * 100 END", 1),
        "trend_pct": fixed_sql("sgn * CASE WHEN abs(first) > 1e-10 THEN (last - first) / abs(first) * 100 ELSE (last - first) * 100 END", 1),
        "n_sigma": fixed_sql("score * 2", 1), "score": fixed_sql("score", 2),
        "cv": fixed_sql("CASE WHEN abs(vmean) > 1e-10 THEN vstd / abs(vmean) ELSE vstd END", 2),
        "vrange": fixed_sql("vmax - vmin", 4),
        "tag": "'[' || upper(severity) || ']'",
    }
    for c in ("vmax", "vmin", "first", "last", "pre_mean", "post_mean", "base_mean", "base_std"):
        names[c] = fixed_sql(c, 4)
    whens = []
    for i, name in enumerate(patterns.PATTERNS):
        out, rest = [], patterns.TEMPLATES[name] + patterns.TAIL
        while "{" in rest:
            text, rest = rest.split("{", 1)
            field, rest = rest.split("}", 1)
            out += [f"'{text}'", names[field]]
        whens.append(f"WHEN {i} THEN " + " || ".join([*out, f"'{rest}'"]))
    return "CASE class_no " + "\n ".join(whens) + " END"


@query(
    "f3_pattern_descriptions",
    CLASSED.rstrip()
    + """,
tx AS (SELECT *, (end_ts - start_ts) // 60 AS minutes, CASE WHEN class_no IN (1, 3) THEN -1.0 ELSE 1.0 END AS sgn,
  strftime(to_timestamp(start_ts + 28800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start FROM sv)
SELECT incident_id, metric, """
    + _template_sql()
    + " AS description FROM tx",
)
def f3(t):
    local = F.from_utc_timestamp(F.timestamp_seconds("start_ts"), "Asia/Shanghai")
    shapes = (
        window_shapes(t)
        .withColumn("start", F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
        .withColumn("minutes", F.expr("(end_ts - start_ts) div 60"))
    )
    return patterns.describe(patterns.deviation_scores(shapes)).select("incident_id", "metric", "description")


@query(
    "a22_cross_metric_alerts",
    CLASSED + "SELECT incident_id, service, count(*) AS n_metrics FROM sv GROUP BY ALL HAVING count(*) >= 2",
)
def a22(t):
    return patterns.cross_metric_alerts(patterns.deviation_scores(window_shapes(t)))


ERR = MW + """,
st AS (SELECT incident_id, metric, avg(value) AS m, stddev_pop(value) AS s FROM mw WHERE k < 15 GROUP BY ALL),
er AS (SELECT mw.*, k < 15 AS train, ((value - m) / CASE WHEN s = 0 THEN 1e-6 ELSE s END) *
  ((value - m) / CASE WHEN s = 0 THEN 1e-6 ELSE s END) AS error FROM mw JOIN st USING (incident_id, metric)),
steps AS (SELECT incident_id, k, train, avg(error) AS score FROM er GROUP BY ALL),
lim AS (SELECT incident_id, quantile_cont(score, 0.99) AS threshold FROM steps WHERE train GROUP BY 1),
ss AS (SELECT steps.*, threshold, NOT train AND score > threshold AS anomalous FROM steps JOIN lim USING (incident_id))
"""


def errors(t):
    return detect.z_errors(metric_windows(t), TRAIN)


@query(
    "a18_step_scores",
    ERR + "SELECT incident_id, k, round(score, 6) AS score, round(threshold, 6) AS threshold, anomalous FROM ss",
)
def a18_steps(t):
    return detect.step_scores(errors(t)).select(
        "incident_id", "k", r6("score", "score"), r6("threshold", "threshold"), "anomalous"
    )


@query(
    "a18_incident_anomaly",
    ERR + "SELECT incident_id, bool_or(anomalous) AS is_anomalous, CAST(count(*) FILTER (anomalous) AS BIGINT) AS n_steps FROM ss GROUP BY 1",
)
def a18_incident(t):
    return detect.step_scores(errors(t)).groupBy("incident_id").agg(
        F.bool_or("anomalous").alias("is_anomalous"), F.count_if("anomalous").alias("n_steps")
    )


@query(
    "a18_feature_ranking",
    ERR
    + """,
tot AS (SELECT incident_id, metric, round(sum(error), 6) AS total FROM er WHERE NOT train GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY total DESC, metric) AS rank FROM tot""",
)
def a18_ranking(t):
    total = detect.feature_ranking(errors(t)).withColumn("total", r6("total"))
    return ranking.rank_within(total, ["incident_id"], [F.desc("total"), "metric"])


@query(
    "a19_anomalous_feature_frequency",
    ERR
    + """,
fl AS (SELECT incident_id, metric, quantile_cont(error, 0.97) AS lim97 FROM er WHERE NOT train GROUP BY ALL),
hit AS (SELECT incident_id, metric, count(*) AS n FROM er JOIN fl USING (incident_id, metric)
  JOIN ss USING (incident_id, k) WHERE NOT er.train AND error > lim97 AND anomalous GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY n DESC, metric) AS rank FROM hit) WHERE rank <= 10""",
)
def a19(t):
    err = errors(t)
    flags = detect.feature_flags(err, detect.step_scores(err))
    counts = flags.groupBy("incident_id", "metric").agg(F.count("*").alias("n"))
    return ranking.rank_within(counts, ["incident_id"], [F.desc("n"), "metric"]).filter("rank <= 10")


ETA = ERR + """,
et AS (SELECT incident_id, metric, m + 2 * greatest(s, 1e-8) AS threshold FROM st),
eta AS (SELECT incident_id, metric, coalesce(max(abs(value - threshold) / nullif(threshold, 0)) FILTER (value > threshold), 0.0) AS eta,
  min(k) FILTER (value > threshold) AS first_step FROM mw JOIN et USING (incident_id, metric) WHERE k >= 15 GROUP BY ALL)
"""


def window_eta(t):
    return detect.eta(detect.sigma_thresholds(metric_windows(t), TRAIN, 2.0))


@query("a20_eta", ETA + "SELECT incident_id, metric, round(eta, 6) AS eta, first_step FROM eta")
def a20(t):
    return window_eta(t).select("incident_id", "metric", r6("eta", "eta"), "first_step")


MULTI = ETA + """,
tot AS (SELECT incident_id, metric, sum(error) AS total FROM er WHERE NOT train GROUP BY ALL),
em AS (SELECT incident_id, metric, eta, total, CASE WHEN max(total) OVER w > 0 AND max(eta) OVER w > 0
    THEN total / max(total) OVER w * max(eta) OVER w ELSE total END AS eta_multi
  FROM tot JOIN eta USING (incident_id, metric) WINDOW w AS (PARTITION BY incident_id))
"""


def eta_channels(t):
    return detect.scaled_to(detect.feature_ranking(errors(t)), window_eta(t))


@query("a21_multivariate_eta", MULTI + "SELECT incident_id, metric, round(eta_multi, 6) AS eta_multi FROM em")
def a21(t):
    return eta_channels(t).select("incident_id", "metric", r6("eta_multi", "eta_multi"))


@query(
    "w22_direction_events",
    ERR
    + """SELECT incident_id, metric, round(avg(sqrt(error)), 6) AS mean_z, avg(sqrt(error)) > 1.5 AS anomalous,
  CASE WHEN avg(value) > min(m) THEN 'up' ELSE 'down' END AS direction
FROM er JOIN st USING (incident_id, metric) WHERE NOT train GROUP BY ALL""",
)
def w22(t):
    out = detect.direction_events(metric_windows(t), TRAIN, limit=1.5)
    return out.select("incident_id", "metric", r6("mean_z", "mean_z"), "anomalous", "direction")


for _name, _depth, _two in (
    ("w16_tail_threshold", 0, False),
    ("w17_tail_threshold_two_sided", 0, True),
    ("w18_tail_threshold_drift", 10, False),
    ("w19_tail_threshold_drift_two_sided", 10, True),
):

    def _run(t, depth=_depth, two=_two):
        return detect.adaptive_thresholds(metric_windows(t), depth=depth, two_sided=two)

    query(_name)(_run)


@query("w20_drift_eta")
def w20(t):
    tested = detect.adaptive_thresholds(metric_windows(t), depth=300)
    return detect.eta(tested)


HOUR = 3600


def hourly_series(t):
    """Hourly averages of every (service, kpi), numbered along time: several hundred points each."""
    hour = F.expr(f"ts div {HOUR}")
    means = t.events.groupBy("service", "event_type", hour.alias("hour")).agg(r6(F.avg("value"), "value"))
    metric = F.concat_ws("_", "service", "event_type").alias("metric")
    return means.select(metric, F.col("hour").alias("k"), "value")


for _name, _depth, _two in (
    ("w16_likelihood_threshold", 0, False),
    ("w17_likelihood_threshold_two_sided", 0, True),
    ("w18_likelihood_threshold_drift", 10, False),
    ("w19_likelihood_threshold_drift_two_sided", 10, True),
):

    def _run_likelihood(t, depth=_depth, two=_two):
        return detect.adaptive_thresholds(hourly_series(t), depth=depth, two_sided=two, keys=["metric"], fit="likelihood")

    query(_name)(_run_likelihood)


@query("w20_likelihood_drift_eta")
def w20_likelihood(t):
    tested = detect.adaptive_thresholds(hourly_series(t), depth=300, keys=["metric"], fit="likelihood")
    return detect.eta(tested, ["metric"])
