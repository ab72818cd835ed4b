"""Queries on metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.numbers import r6
from faultline.operators import series as se
from faultline.plans.registry import query
from faultline.plans.windows import MW, metric_windows

KEY = ["metric"]

# all series on the union of times; g.value is null where a series has no point
GRID = """
times AS (SELECT DISTINCT t FROM metrics),
names AS (SELECT DISTINCT metric FROM metrics),
g AS (SELECT n.metric, x.t, m.value FROM names n CROSS JOIN times x
  LEFT JOIN metrics m ON m.metric = n.metric AND m.t = x.t)
"""
BACK = "(PARTITION BY metric ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "(PARTITION BY metric ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def grid(t):
    return se.on_grid(t.metrics, KEY)


def zeros(t):
    """The grid with 0 for missing, as raw exports hold it."""
    return grid(t).withColumn("value", F.coalesce("value", F.lit(0.0)))


@query(
    "a1_bin_sums",
    """n AS (SELECT metric, max(t) + 1 AS len FROM metrics GROUP BY metric),
b AS (SELECT metric, 0 AS bin, value FROM metrics WHERE t BETWEEN 1 AND 4
  UNION ALL SELECT metric, t // 4, value FROM metrics WHERE t >= 4)
SELECT metric, CAST(bin AS BIGINT) AS bin, round(sum(value), 6) AS total, count(*) AS n FROM b JOIN n USING (metric)
WHERE (bin + 1) * 4 <= len GROUP BY ALL""",
)
def a1(t):
    return se.bin_sums(t.metrics, KEY, 4).select("metric", "bin", r6("total", "total"), "n")


@query(
    "a2_series_mean_std",
    """SELECT service, kpi, round(avg(value), 6) AS mean,
  round(CASE WHEN stddev_pop(value) = 0 THEN 1e-6 ELSE stddev_pop(value) END, 6) AS std
FROM metrics GROUP BY service, kpi""",
)
def a2(t):
    std = F.stddev_pop("value")
    return t.metrics.groupBy("service", "kpi").agg(
        r6(F.avg("value"), "mean"), r6(F.when(std == 0, 1e-6).otherwise(std), "std")
    )


@query(
    "w1_zero_fill_previous_latter",
    GRID
    + f"""SELECT metric, t, coalesce(last_value(value IGNORE NULLS) OVER {BACK},
  first_value(value IGNORE NULLS) OVER {AHEAD}, 0.0) AS filled FROM g""",
)
def w1(t):
    return se.zero_fill(zeros(t), KEY).select("metric", "t", "filled")


NEIGHBOURS = GRID + f""",
p AS (SELECT metric, t, value,
  max(CASE WHEN value IS NOT NULL THEN t END) OVER {BACK} AS bt,
  min(CASE WHEN value IS NOT NULL THEN t END) OVER {AHEAD} AS nt,
  last_value(value IGNORE NULLS) OVER {BACK} AS bv, first_value(value IGNORE NULLS) OVER {AHEAD} AS av FROM g)
"""
INTERPOLATED = {
    "previous": "coalesce(bv, av)",
    "next": "coalesce(av, bv)",
    "nearest": "CASE WHEN bt IS NULL OR nt - t < t - bt THEN av ELSE bv END",
}


def _fill_query(method: str):
    def run(t):
        return se.zero_fill(zeros(t), KEY, method).select("metric", "t", "filled")

    return run


for _m, _e in INTERPOLATED.items():
    query(f"w2_interpolate_{_m}", NEIGHBOURS + f"SELECT metric, t, {_e} AS filled FROM p")(_fill_query(_m))


@query(
    "w2_interpolate_linear",
    NEIGHBOURS
    + """,
e AS (SELECT metric, list(t ORDER BY t) AS ts, list(value ORDER BY t) AS vs FROM metrics GROUP BY metric)
SELECT metric, t, round(CASE WHEN bt = t THEN value
  WHEN bt IS NULL THEN vs[1] + (vs[2] - vs[1]) / (ts[2] - ts[1]) * (t - ts[1])
  WHEN nt IS NULL THEN vs[-2] + (vs[-1] - vs[-2]) / (ts[-1] - ts[-2]) * (t - ts[-2])
  ELSE bv + (av - bv) / (nt - bt) * (t - bt) END, 6) AS filled FROM p JOIN e USING (metric)""",
)
def w2_linear(t):
    return se.zero_fill(zeros(t), KEY, "linear").select("metric", "t", r6("filled", "filled"))


@query(
    "w3_align_to_grid",
    GRID
    + f"""SELECT metric, t, value IS NULL AS was_missing, coalesce(last_value(value IGNORE NULLS) OVER {BACK},
  first_value(value IGNORE NULLS) OVER {AHEAD}, 0.0) AS filled FROM g""",
)
def w3(t):
    return se.fill(grid(t), KEY).select(
        "metric", "t", F.col("value").isNull().alias("was_missing"), "filled"
    )


@query(
    "w4_normalise_whole",
    """SELECT metric, t, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z
FROM metrics WINDOW w AS (PARTITION BY metric)""",
)
def w4(t):
    return se.zscore(t.metrics, KEY).select("metric", "t", r6("z", "z"))


HALF = """
h AS (SELECT metric, t, value, row_number() OVER (PARTITION BY metric ORDER BY t)
  <= count(*) OVER (PARTITION BY metric) // 2 AS train FROM metrics)
"""


@query(
    "w5_split_normalise_by_train_half",
    HALF
    + """,
s AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS sd FROM h WHERE train GROUP BY metric)
SELECT metric, t, train, round((value - m) / CASE WHEN sd = 0 THEN 1e-6 ELSE sd END, 6) AS z
FROM h JOIN s USING (metric)""",
)
def w5(t):
    halves = t.metrics.withColumn("train", se.is_train(KEY))
    return se.zscore(halves, KEY, F.col("train")).select("metric", "t", "train", r6("z", "z"))


@query(
    "w6_lag_windows",
    """o AS (SELECT metric, t, value, row_number() OVER (PARTITION BY metric ORDER BY t) AS rn,
  first_value(value) OVER (PARTITION BY metric ORDER BY t) AS v0 FROM metrics)
SELECT o.metric, o.t, CAST(x.j AS INTEGER) AS pos, coalesce(p.value, o.v0) AS value FROM o CROSS JOIN range(5) x(j)
LEFT JOIN o p ON p.metric = o.metric AND p.rn = o.rn - 5 + x.j""",
)
def w6(t):
    return se.lag_windows(t.metrics, KEY, 5).select("metric", "t", F.posexplode("window").alias("pos", "value"))


@query(
    "w8_moving_mean",
    """SELECT metric, t, round(mean, 6) AS mean FROM (SELECT metric, t, row_number() OVER (PARTITION BY metric ORDER BY t) AS rn,
  avg(value) OVER (PARTITION BY metric ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM metrics)
WHERE rn >= 10""",
)
def w8(t):
    return se.moving_mean(t.metrics, KEY, 10).select("metric", "t", r6("mean", "mean"))


@query(
    "p11_clean_metrics",
    """s AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS sd FROM metrics GROUP BY metric)
SELECT metric, t, round(greatest(-10, least(10, (value - m) / sd)), 6) AS z FROM metrics JOIN s USING (metric) WHERE sd > 0""",
)
def p11(t):
    return se.clean(t.metrics, KEY).select("metric", "t", r6("z", "z"))


SHAPE = MW + """,
o AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv,
  avg(value) OVER a AS m, stddev_pop(value) OVER a AS s FROM mw
  WINDOW w AS (PARTITION BY incident_id, metric ORDER BY k), a AS (PARTITION BY incident_id, metric)),
sh AS (SELECT incident_id, metric, min(service) AS service, min(kpi) AS kpi, min(ts) AS start_ts, max(ts) AS end_ts,
  arg_min(value, k) AS first, arg_max(value, k) AS last, min(value) AS vmin, max(value) AS vmax, avg(value) AS vmean,
  stddev_pop(value) AS vstd, max(abs(value - pv)) AS max_step, CAST(count(*) FILTER (value > pv AND value > nv) AS BIGINT) AS peaks,
  CAST(count(*) FILTER (value < pv AND value < nv) AS BIGINT) AS dips,
  avg(value) FILTER (k < 15) AS pre_mean, avg(value) FILTER (k >= 15) AS post_mean,
  count(*) FILTER (value > m + 2 * s) AS n_high, count(*) FILTER (value < m - 2 * s) AS n_low,
  max(k) FILTER (value > m + 2 * s) - min(k) FILTER (value > m + 2 * s) AS high_span,
  max(k) FILTER (value < m - 2 * s) - min(k) FILTER (value < m - 2 * s) AS low_span FROM o GROUP BY incident_id, metric)
"""


def shapes(t):
    return se.shape(metric_windows(t), ["incident_id", "metric"])


@query("w12_peaks_and_dips", SHAPE + "SELECT incident_id, metric, peaks, dips FROM sh")
def w12(t):
    return shapes(t).select("incident_id", "metric", "peaks", "dips")


@query(
    "w13_level_shift",
    SHAPE
    + """SELECT incident_id, metric, round(pre_mean, 6) AS pre_mean, round(post_mean, 6) AS post_mean,
  round(CASE WHEN abs(pre_mean) > 1e-10 THEN (post_mean - pre_mean) / abs(pre_mean) * 100
    ELSE (post_mean - pre_mean) * 100 END, 6) AS shift_pct FROM sh""",
)
def w13(t):
    pct = se.percent_change(F.col("post_mean"), F.col("pre_mean"))
    return shapes(t).select(
        "incident_id", "metric", r6("pre_mean", "pre_mean"), r6("post_mean", "post_mean"), r6(pct, "shift_pct")
    )


@query(
    "w14_trend_and_range",
    SHAPE
    + """SELECT incident_id, metric, first, last, vmin, vmax, round(vmax - vmin, 6) AS value_range,
  round(CASE WHEN abs(vmean) > 1e-10 THEN vstd / abs(vmean) ELSE vstd END, 6) AS cv,
  round(CASE WHEN abs(first) > 1e-10 THEN (last - first) / abs(first) * 100 ELSE (last - first) * 100 END, 6) AS change_pct
FROM sh""",
)
def w14(t):
    cv = F.when(F.abs("vmean") > 1e-10, F.col("vstd") / F.abs("vmean")).otherwise(F.col("vstd"))
    return shapes(t).select(
        "incident_id", "metric", "first", "last", "vmin", "vmax",
        r6(F.col("vmax") - F.col("vmin"), "value_range"), r6(cv, "cv"),
        r6(se.percent_change(F.col("last"), F.col("first")), "change_pct"),
    )


@query(
    "a8_series_features",
    """a AS (SELECT metric, avg(abs(value)) + 1e-8 AS scale FROM metrics GROUP BY metric),
r AS (SELECT m.metric, m.t, m.value, m.value / scale AS rel FROM metrics m JOIN a USING (metric)),
s AS (SELECT *, rel - lag(rel) OVER (PARTITION BY metric ORDER BY t) AS step FROM r),
u AS (SELECT *, sign(step) <> lag(sign(step)) OVER (PARTITION BY metric ORDER BY t) AS turn FROM s)
SELECT metric, round(avg(rel), 6) AS rel_mean, round(stddev_pop(rel), 6) AS rel_std, round(max(rel), 6) AS rel_max,
  round(min(rel), 6) AS rel_min, round(quantile_cont(rel, 0.75) - quantile_cont(rel, 0.25), 6) AS iqr,
  round(avg(abs(step)), 6) AS volatility, round(arg_max(rel, t) - arg_min(rel, t), 6) AS trend,
  CAST(count(*) FILTER (turn) AS DOUBLE) AS turns FROM u GROUP BY metric""",
)
def a8(t):
    feats = se.series_features(t.metrics, KEY)
    return feats.select("metric", *[r6(c, c) for c in feats.columns if c != "metric"])
