"""Queries that score rankings against known causes and compare runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from faultline.functions import quality
from faultline.functions.numbers import r6
from faultline.operators import evaluation as ev
from faultline.operators import fusion, ranking
from faultline.operators.scale import global_running_sum, grouped_quantiles
from faultline.plans import rankings as rk
from faultline.plans.registry import query

TRUTH = """
truth AS (SELECT incident_id, day, failure_type, level, service, CASE WHEN level = 'pod' THEN service || '-0' ELSE service END AS entity FROM incidents),
cand AS (SELECT DISTINCT incident_id, c FROM (SELECT incident_id, entity AS c FROM truth
  UNION ALL SELECT incident_id, regexp_replace(entity, '-[0-9]+', '', 'g') FROM truth WHERE level = 'pod'
  UNION ALL SELECT incident_id, regexp_replace(entity, '[0-9-]+$', '') FROM truth WHERE level = 'service'))
"""


def truths(t):
    entity = F.when(F.col("level") == "pod", F.concat("service", F.lit("-0"))).otherwise(F.col("service"))
    return t.incidents.withColumn("entity", entity).withColumn(
        "candidates", ev.truth_candidates(F.col("entity"), F.col("level"))
    )


def named(df):
    return df.withColumnRenamed("service", "name")


@query("f2_truth_candidates", TRUTH + "SELECT incident_id, c AS candidate FROM cand")
def f2(t):
    return truths(t).select("incident_id", F.explode("candidates").alias("candidate"))


RANKS = rk.DUAL.rstrip() + "," + TRUTH.rstrip() + """,
ra AS (SELECT t.incident_id, t.day, (SELECT coalesce(min(rank), 99) FROM anchor a JOIN cand c ON c.incident_id = a.incident_id AND contains(a.service, c.c)
  WHERE a.incident_id = t.incident_id AND a.rank <= 5) AS truth_rank FROM truth t WHERE incident_id IN (SELECT incident_id FROM anchor)),
rt AS (SELECT t.incident_id, t.day, (SELECT coalesce(min(rank), 99) FROM trace a JOIN cand c ON c.incident_id = a.incident_id AND contains(a.service, c.c)
  WHERE a.incident_id = t.incident_id AND a.rank <= 5) AS truth_rank FROM truth t WHERE incident_id IN (SELECT incident_id FROM trace))
"""


def list_ranks(t, which: int):
    rows = named(rk.span_lists(t)[which]).filter("rank <= 5")
    return ev.truth_rank(rows, truths(t))


ACC = "count(*) AS n, round(avg(CASE WHEN truth_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS ac1, round(avg(CASE WHEN truth_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS ac3, round(avg(CASE WHEN truth_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS ac5"


def rounded(df, *cols):
    return df.select(*[r6(c, c) if c in cols else F.col(c) for c in df.columns])


@query("r25_rank_of_truth", RANKS + "SELECT incident_id, CAST(truth_rank AS BIGINT) AS truth_rank FROM ra")
def r25(t):
    return list_ranks(t, 0)


@query("a23_topk_accuracy", RANKS + f"SELECT {ACC} FROM ra")
def a23(t):
    return rounded(ev.accuracy(list_ranks(t, 0)), "ac1", "ac3", "ac5")


@query(
    "a26_hit_rates_mrr",
    RANKS
    + "SELECT "
    + ", ".join(f"round(avg(CASE WHEN truth_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hr{k}" for k in range(1, 6))
    + ", round(avg(CASE WHEN truth_rank <= 3 THEN 1.0::DOUBLE / truth_rank ELSE 0.0 END), 6) AS mrr3 FROM ra",
)
def a26(t):
    out = ev.hit_rates(list_ranks(t, 0))
    return rounded(out, *out.columns)


@query(
    "a33_accuracy_by_date",
    RANKS + f"SELECT day, {ACC} FROM ra GROUP BY ROLLUP (day)",
)
def a33(t):
    dated = list_ranks(t, 0).join(t.incidents.select("incident_id", "day"), "incident_id")
    r = F.col("truth_rank")
    return dated.rollup("day").agg(
        F.count("*").alias("n"),
        *[r6(F.avg((r <= k).cast("double")), f"ac{k}") for k in (1, 3, 5)],
    )


SETS = rk.DUAL.rstrip() + """,
ts AS (SELECT DISTINCT i.incident_id, o.service AS name FROM incidents i JOIN incidents o ON o.day = i.day AND o.failure_type = i.failure_type),
nt AS (SELECT incident_id, count(*) AS nt FROM ts GROUP BY 1)
"""


def truth_sets(t):
    """Several true services: those with the same failure on the same day."""
    i = t.incidents
    other = i.select("day", "failure_type", F.col("service").alias("name")).distinct()
    return i.select("incident_id", "day", "failure_type").join(other, ["day", "failure_type"]).select(
        "incident_id", "name"
    )


@query(
    "a24_precision_at_k",
    SETS
    + """,
h AS (SELECT ts.incident_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 2) AS h2, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 4) AS h4, count(*) FILTER (rank <= 5) AS h5
  FROM ts LEFT JOIN anchor a ON a.incident_id = ts.incident_id AND a.service = ts.name GROUP BY 1)
SELECT incident_id, """
    + ", ".join(f"round(h{k}::DOUBLE / least(nt, {k}), 6) AS pr{k}" for k in range(1, 6))
    + ", round(("
    + " + ".join(f"h{k}::DOUBLE / least(nt, {k})" for k in range(1, 6))
    + ") / 5, 6) AS pr_avg FROM h JOIN nt USING (incident_id)",
)
def a24(t):
    out = ev.precision_at(named(rk.span_lists(t)[0]), truth_sets(t))
    return rounded(out, *out.columns[1:])


@query(
    "a25_rank_accuracy",
    SETS
    + """,
n AS (SELECT incident_id, count(*) AS n FROM anchor GROUP BY 1)
SELECT ts.incident_id, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE (n.n - greatest(0, rank - nt))::DOUBLE / n.n END), 6) AS acc
FROM ts JOIN nt USING (incident_id) JOIN n ON n.incident_id = ts.incident_id LEFT JOIN anchor a ON a.incident_id = ts.incident_id AND a.service = ts.name GROUP BY 1""",
)
def a25(t):
    return rounded(ev.rank_accuracy(named(rk.span_lists(t)[0]), truth_sets(t)), "acc")


@query(
    "a42_evaluate_gamma_ranking",
    rk.DUAL.rstrip()
    + """,
tm AS (SELECT DISTINCT c.incident_id, c.metric AS name FROM chan c JOIN incidents i USING (incident_id) WHERE c.metric LIKE i.service || '_%'),
nt AS (SELECT incident_id, count(*) AS nt FROM tm GROUP BY 1),
rkd AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY g_multi DESC, metric) AS rank, count(*) OVER (PARTITION BY incident_id) AS n FROM chan)
SELECT tm.incident_id, round(avg((n - greatest(0, rank - nt))::DOUBLE / n), 6) AS acc FROM tm JOIN nt USING (incident_id) JOIN rkd ON rkd.incident_id = tm.incident_id AND rkd.metric = tm.name GROUP BY 1""",
)
def a42(t):
    ranked = ranking.rank_within(rk.gammas(t), ["incident_id"], [F.desc("gamma"), "metric"])
    ranked = ranked.withColumnRenamed("metric", "name")
    own = ranked.join(t.incidents.select("incident_id", "service"), "incident_id").filter(
        F.col("name").startswith(F.concat("service", F.lit("_")))
    )
    return rounded(ev.rank_accuracy(ranked, own.select("incident_id", "name")), "acc")


CASES = RANKS.rstrip() + """,
cs AS (SELECT t.incident_id, t.day, t.service, ra.truth_rank AS anchor_rank, rt.truth_rank AS trace_rank FROM truth t LEFT JOIN ra USING (incident_id) LEFT JOIN rt USING (incident_id))
"""


def case_ranks(t):
    a = list_ranks(t, 0).withColumnRenamed("truth_rank", "anchor_rank")
    b = list_ranks(t, 1).withColumnRenamed("truth_rank", "trace_rank")
    return t.incidents.select("incident_id", "day", "service").join(a, "incident_id", "left").join(
        b, "incident_id", "left"
    )


@query(
    "a43_case_results",
    CASES
    + """SELECT incident_id, service AS truth, coalesce(anchor_rank <= 1, false) AS hit1, coalesce(anchor_rank <= 3, false) AS hit3, coalesce(anchor_rank <= 5, false) AS hit5, anchor_rank IS NOT NULL AS has_prediction FROM cs""",
)
def a43(t):
    r = F.col("anchor_rank")
    hit = lambda k: F.coalesce(r <= k, F.lit(False)).alias(f"hit{k}")
    return case_ranks(t).select(
        "incident_id", F.col("service").alias("truth"), hit(1), hit(3), hit(5),
        r.isNotNull().alias("has_prediction"),
    )


@query(
    "j15_case_alignment",
    CASES
    + """,
lo AS (SELECT incident_id, 'anchor' AS method, anchor_rank AS r FROM cs WHERE anchor_rank IS NOT NULL UNION ALL SELECT incident_id, 'trace', trace_rank FROM cs WHERE trace_rank IS NOT NULL)
SELECT incident_id, count(*) AS n_methods, CAST(min(r) AS BIGINT) AS best_rank FROM lo GROUP BY 1 HAVING count(*) >= 2""",
)
def j15(t):
    methods = [list_ranks(t, i).withColumn("method", F.lit(m)) for i, m in enumerate(("anchor", "trace"))]
    return (
        methods[0].unionByName(methods[1]).groupBy("incident_id")
        .agg(F.count("*").alias("n_methods"), F.min("truth_rank").alias("best_rank"))
        .filter("n_methods >= 2")
    )


@query(
    "j20_run_comparison",
    CASES
    + """SELECT CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (anchor_rank IS NULL AND trace_rank IS NOT NULL) AS BIGINT) AS only_new,
  CAST(count(*) FILTER (anchor_rank = 1 AND trace_rank <> 1) AS BIGINT) AS lost_top1, CAST(count(*) FILTER (anchor_rank <> 1 AND trace_rank = 1) AS BIGINT) AS won_top1,
  CAST(count(*) FILTER (anchor_rank > trace_rank) AS BIGINT) AS better, CAST(count(*) FILTER (anchor_rank < trace_rank) AS BIGINT) AS worse FROM cs""",
)
def j20(t):
    old = list_ranks(t, 0).withColumnRenamed("truth_rank", "o")
    new = list_ranks(t, 1).withColumnRenamed("truth_rank", "n")
    both = t.incidents.select("incident_id").join(old.join(new, "incident_id", "full"), "incident_id", "left")
    o, n = F.col("o"), F.col("n")
    return both.agg(
        F.count("*").alias("cases"),
        F.count_if(o.isNull() & n.isNotNull()).alias("only_new"),
        F.count_if((o == 1) & (n != 1)).alias("lost_top1"),
        F.count_if((o != 1) & (n == 1)).alias("won_top1"),
        F.count_if(o > n).alias("better"),
        F.count_if(o < n).alias("worse"),
    )


@query(
    "a34_replay_fidelity",
    rk.U_SQL
    + """,
la AS (SELECT incident_id, list(service ORDER BY rank) AS v FROM anchor WHERE rank <= 5 GROUP BY 1), lb AS (SELECT incident_id, list(service ORDER BY rank) AS v FROM trace WHERE rank <= 5 GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN la.v[1] = lb.v[1] THEN 1.0 ELSE 0.0 END), 6) AS same_top1, round(avg(CASE WHEN la.v = lb.v THEN 1.0 ELSE 0.0 END), 6) AS same_top5 FROM la JOIN lb USING (incident_id)""",
)
def a34(t):
    same = lambda k: F.avg((F.slice("a", 1, k) == F.slice("b", 1, k)).cast("double"))
    return rk.two_lists(t).agg(
        F.count("*").alias("n"), r6(same(1), "same_top1"), r6(same(5), "same_top5")
    )


SWEEPS = {
    "w_dual": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "w_trace": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7],
    "w_causal": [0.1, 0.2, 0.3, 0.4, 0.5],
    "alpha": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8],
}


def sweep_params() -> list[dict]:
    return [{"param_id": f"{k}={v}", k: v} for k, vs in SWEEPS.items() for v in vs]


def params_sql(params: list[dict]) -> str:
    rows = []
    for p in params:
        full = {**fusion.FUSION_PARAMS, **p}
        rows.append(
            f"SELECT '{p['param_id']}' AS param_id, "
            + ", ".join(
                f"{str(full[c]).lower()} AS {c}" if isinstance(full[c], bool) else f"{full[c]}::DOUBLE AS {c}"
                for c in fusion.FUSION_PARAMS
            )
        )
    return " UNION ALL ".join(rows)


# the last ten days validate, the days before test
SPLIT_DAY = 19_743


def sweep_sql(params: list[dict]) -> str:
    return (
        rk.fuse_sql(params_sql(params)).rstrip()
        + ","
        + TRUTH.rstrip()
        + f""",
fr AS (SELECT f.param_id, t.incident_id, CASE WHEN t.day >= {SPLIT_DAY} THEN 'validation' ELSE 'test' END AS split, coalesce(min(f.rank) FILTER (contains(f.service, c.c)), 99) AS truth_rank
  FROM fused f JOIN truth t USING (incident_id) JOIN cand c ON c.incident_id = f.incident_id GROUP BY ALL)
SELECT param_id, split, {ACC} FROM fr GROUP BY ALL"""
    )


def sweep(t, params):
    rows = named(rk.fused(t, params))
    ranks = ev.truth_rank(rows, truths(t), ("param_id", "incident_id"))
    split = F.when(F.col("day") >= SPLIT_DAY, "validation").otherwise("test").alias("split")
    dated = ranks.join(t.incidents.select("incident_id", split), "incident_id")
    return rounded(ev.accuracy(dated, ("param_id", "split")), "ac1", "ac3", "ac5")


@query("r16_parameter_sweep", sweep_sql(sweep_params()))
def r16(t):
    return sweep(t, sweep_params())


ABLATIONS = [{"param_id": "default"}, {"param_id": "protection off", "protect": False}, {"param_id": "no consensus", "alpha": 0.0}]


@query("r17_ablations", sweep_sql(ABLATIONS))
def r17(t):
    return sweep(t, ABLATIONS)


@query(
    "r17_reciprocal_rank_ablation",
    rk.RRF.rstrip()
    + ","
    + TRUTH.rstrip()
    + f""",
fr AS (SELECT t.incident_id, CASE WHEN t.day >= {SPLIT_DAY} THEN 'validation' ELSE 'test' END AS split, coalesce(min(f.rank) FILTER (contains(f.service, c.c)), 99) AS truth_rank
  FROM rrf f JOIN truth t USING (incident_id) JOIN cand c ON c.incident_id = f.incident_id GROUP BY ALL)
SELECT split, {ACC} FROM fr GROUP BY ALL""",
)
def r17_rrf(t):
    ranks = ev.truth_rank(named(fusion.reciprocal_rank_fusion(rk.four_lists(t))), truths(t))
    split = F.when(F.col("day") >= SPLIT_DAY, "validation").otherwise("test").alias("split")
    dated = ranks.join(t.incidents.select("incident_id", split), "incident_id")
    return rounded(ev.accuracy(dated, ("split",)), "ac1", "ac3", "ac5")


def fused_case_sql() -> str:
    return (
        rk.fuse_sql(rk.ONE.format(c="false", p="true", l="false")).rstrip()
        + ","
        + TRUTH.rstrip()
        + """,
fr AS (SELECT t.incident_id, t.day, min(s.scenario) AS scenario, coalesce(min(f.rank) FILTER (contains(f.service, c.c)), 99) AS fused_rank
  FROM fused f JOIN truth t USING (incident_id) JOIN cand c ON c.incident_id = f.incident_id JOIN scen s ON s.incident_id = f.incident_id GROUP BY ALL),
ar AS (SELECT t.incident_id, coalesce(min(a.rank) FILTER (contains(a.service, c.c)), 99) AS anchor_rank FROM anchor a JOIN truth t USING (incident_id) JOIN cand c ON c.incident_id = a.incident_id WHERE a.rank <= 5 GROUP BY 1),
fc AS (SELECT * FROM fr JOIN ar USING (incident_id))
"""
    )


def fused_cases(t):
    f = ev.truth_rank(named(rk.fused(t)), truths(t)).withColumnRenamed("truth_rank", "fused_rank")
    a = list_ranks(t, 0).withColumnRenamed("truth_rank", "anchor_rank")
    kinds = rk.channel_tops(t).select("incident_id", "scenario")
    return f.join(a, "incident_id").join(kinds, "incident_id")


def _share(col, k):
    return f"round(avg(CASE WHEN {col} <= {k} THEN 1.0 ELSE 0.0 END), 6)"


@query(
    "a31_scenario_breakdown",
    fused_case_sql()
    + "SELECT scenario, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM fc), 6) AS share, "
    + ", ".join(f"{_share(c + '_rank', k)} AS {c}_ac{k}" for c in ("anchor", "fused") for k in (1, 3, 5))
    + " FROM fc GROUP BY scenario",
)
def a31(t):
    cases = fused_cases(t)
    total = cases.agg(F.count("*")).scalar()
    at = lambda c, k: r6(F.avg((F.col(f"{c}_rank") <= k).cast("double")), f"{c}_ac{k}")
    out = cases.groupBy("scenario").agg(
        F.count("*").alias("n"), *[at(c, k) for c in ("anchor", "fused") for k in (1, 3, 5)]
    )
    return out.withColumn("share", r6(F.col("n") / total))


@query(
    "a32_fusion_net_effect",
    fused_case_sql()
    + "SELECT scenario = 'consistent' AS fallback, count(*) AS n, "
    + ", ".join(f"round(avg(CASE WHEN fused_rank <= {k} THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN anchor_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS gain{k}" for k in (1, 3, 5))
    + " FROM fc GROUP BY 1",
)
def a32(t):
    gain = lambda k: F.avg((F.col("fused_rank") <= k).cast("double")) - F.avg((F.col("anchor_rank") <= k).cast("double"))
    return fused_cases(t).groupBy((F.col("scenario") == fusion.CONSISTENT).alias("fallback")).agg(
        F.count("*").alias("n"), *[r6(gain(k), f"gain{k}") for k in (1, 3, 5)]
    )


def _poisson_sql() -> str:
    """The same steps as ``evaluation.poisson_weight``."""
    total, term, parts = 0.0, math.exp(-1), []
    for i in range(ev.POISSON_STEPS):
        total += term
        parts.append(f"CASE WHEN u >= {total!r} THEN 1 ELSE 0 END")
        term /= i + 1
    return " + ".join(parts)


POISSON_SQL = _poisson_sql()


@query(
    "a35_paired_bootstrap",
    fused_case_sql()
    + f""",
dl AS (SELECT incident_id AS case_id, CAST(fused_rank <= 3 AS INT) - CAST(anchor_rank <= 3 AS INT) AS delta FROM fc),
dr AS (SELECT boot, delta, ('0x' || substr(md5(case_id || '-' || boot), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM dl CROSS JOIN range(1, 10001) b(boot)),
wg AS (SELECT boot, delta, {POISSON_SQL} AS w FROM dr),
bm AS (SELECT boot, sum(w * delta)::DOUBLE / greatest(sum(w), 1) AS m FROM wg GROUP BY boot)
SELECT round((SELECT avg(delta) FROM dl), 6) AS mean_delta, (SELECT count(*) FROM dl WHERE delta > 0) AS improved, (SELECT count(*) FROM dl WHERE delta < 0) AS regressed,
  round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), 6) AS p_no_gain FROM bm""",
)
def a35(t):
    hit = lambda c: (F.col(c) <= 3).cast("int")
    cases = fused_cases(t).select(
        F.col("incident_id").alias("case_id"), (hit("fused_rank") - hit("anchor_rank")).alias("delta")
    )
    return rounded(ev.paired_bootstrap(cases), "mean_delta", "low", "high", "p_no_gain")


@query(
    "r24_router_rows",
    fused_case_sql()
    + """,
fl AS (SELECT incident_id, list(service ORDER BY rank) AS v FROM fused GROUP BY 1),
al AS (SELECT incident_id, list(service ORDER BY rank) AS v, count(DISTINCT service) AS uniq FROM anchor WHERE rank <= 5 GROUP BY 1),
nd AS (SELECT incident_id, count(*) AS nodes FROM agg GROUP BY 1)
SELECT incident_id, nodes, uniq, list_contains(fl.v, al.v[1]) AS anchor_in_fused, CAST(coalesce(list_position(fl.v, al.v[1]), 6) AS BIGINT) AS anchor_pos,
  CASE WHEN fused_rank < anchor_rank THEN 1 WHEN fused_rank > anchor_rank THEN 0 END AS label
FROM fc JOIN fl USING (incident_id) JOIN al USING (incident_id) JOIN nd USING (incident_id)""",
)
def r24(t):
    return router_rows(t)


def router_rows(t):
    lists = rk.fused(t).groupBy("incident_id").agg(fusion.names_in_order(name="service").alias("f"))
    anchor = rk.span_lists(t)[0]
    own = anchor.groupBy("incident_id").agg(
        fusion.names_in_order(name="service").alias("all"), F.count("*").alias("nodes")
    )
    first = F.get("all", F.lit(0))
    pos = F.array_position("f", first)
    label = F.when(F.col("fused_rank") < F.col("anchor_rank"), 1).when(
        F.col("fused_rank") > F.col("anchor_rank"), 0
    )
    return fused_cases(t).join(lists, "incident_id").join(own, "incident_id").select(
        "incident_id", "nodes",
        F.size(F.array_distinct(F.slice("all", 1, 5))).cast("long").alias("uniq"),
        (pos > 0).alias("anchor_in_fused"),
        F.when(pos > 0, pos).otherwise(6).cast("long").alias("anchor_pos"),
        label.alias("label"),
    )


# -- votes, latencies, classes -------------------------------------------------------------------

VOTES = """
vc AS (SELECT ts // 3600 AS case_id, event_type AS vote, count(*) AS c FROM ev GROUP BY ALL),
vt0 AS (SELECT case_id, CAST(sum(c) AS BIGINT) AS n, max(c) AS best, arg_min(vote, {'a': -c, 'b': vote}) AS lead FROM vc GROUP BY 1),
vl AS (SELECT case_id, count(*) AS leaders FROM vc JOIN vt0 USING (case_id) WHERE c = best GROUP BY 1),
vw AS (SELECT case_id, n, best < (n + 1) // 2 OR leaders > 1 AS is_tie, CASE WHEN NOT (best < (n + 1) // 2 OR leaders > 1) THEN lead END AS winner FROM vt0 JOIN vl USING (case_id))
"""


def winners(t):
    return ev.vote_winners(t.events.select(F.expr("ts div 3600").alias("case_id"), F.col("event_type").alias("vote")))


@query("a28_vote_winners", VOTES + "SELECT * FROM vw")
def a28(t):
    return winners(t)


@query(
    "a28_win_and_tie_rate",
    VOTES
    + "SELECT coalesce(winner, 'tie') AS method, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM vw), 4) AS rate FROM vw GROUP BY 1",
)
def a28_rate(t):
    won = winners(t)
    total = won.agg(F.count("*")).scalar()
    out = won.groupBy(F.coalesce("winner", F.lit("tie")).alias("method")).agg(F.count("*").alias("n"))
    return out.withColumn("rate", F.round(F.col("n") / total, 4))


@query(
    "a29_latency_statistics",
    """SELECT o_orderpriority AS phase, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std, min(o_totalprice) AS min_v, max(o_totalprice) AS max_v,
  round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1""",
)
def a29(t):
    orders = t.table("orders").withColumnRenamed("o_orderpriority", "phase")
    facts = orders.groupBy("phase").agg(
        F.count("*").alias("n"), r6(F.avg("o_totalprice"), "mean"), r6(F.stddev_pop("o_totalprice"), "std"),
        F.min("o_totalprice").alias("min_v"), F.max("o_totalprice").alias("max_v"),
    )
    q = grouped_quantiles(orders, ["phase"], "o_totalprice", {"median": 0.5, "p95": 0.95})
    return facts.join(q.select("phase", r6("median", "median"), r6("p95", "p95")), "phase")


@query(
    "a30_phase_latency",
    "p AS (SELECT trace_id, service, sum(duration) AS d FROM spans GROUP BY ALL) SELECT service AS phase, count(*) AS n, round(avg(d), 6) AS mean FROM p GROUP BY 1",
)
def a30(t):
    # one map of phase durations per case, as case results hold them
    phases = t.spans.groupBy("trace_id", "service").agg(F.sum("duration").alias("d"))
    cases = phases.groupBy("trace_id").agg(
        F.map_from_entries(F.collect_list(F.struct("service", "d"))).alias("phase_latencies")
    )
    rows = cases.select(F.explode("phase_latencies").alias("phase", "d"))
    return rows.groupBy("phase").agg(F.count("*").alias("n"), r6(F.avg("d"), "mean"))


CLASSES = """
cl0 AS (SELECT label AS truth, (list_position(embedding, list_max(embedding)) - 1) % 10 AS predicted FROM embeddings),
cc AS (SELECT class, CAST(sum(is_t) AS BIGINT) AS support, CAST(sum(is_p) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp FROM (
  SELECT truth AS class, 1 AS is_t, 0 AS is_p, CAST(truth = predicted AS INT) AS tp FROM cl0 UNION ALL SELECT predicted, 0, 1, 0 FROM cl0) GROUP BY 1),
cp AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS r FROM cc)
"""


def class_table(t):
    e = t.table("embeddings")
    best = (F.array_position("embedding", F.array_max("embedding")) - 1) % 10
    return ev.class_scores(e.select(F.col("label").cast("long").alias("truth"), best.cast("long").alias("predicted")))


@query(
    "a27_weighted_class_scores",
    CLASSES
    + "SELECT round(sum(support * p) / sum(support), 6) AS pre, round(sum(support * r) / sum(support), 6) AS rec, round(coalesce(2 * (sum(support * p) / sum(support)) * (sum(support * r) / sum(support)) / nullif(sum(support * p) / sum(support) + sum(support * r) / sum(support), 0), 0), 6) AS f1 FROM cp",
)
def a27(t):
    return rounded(ev.weighted_scores(class_table(t)), "pre", "rec", "f1")


@query(
    "m11_macro_class_scores",
    CLASSES
    + "SELECT round(avg(p), 6) AS macro_pre, round(avg(r), 6) AS macro_rec, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS macro_f1, round(sum(tp)::DOUBLE / sum(support)::DOUBLE, 6) AS accuracy FROM cp",
)
def m11(t):
    out = ev.macro_scores(class_table(t))
    return rounded(out, *out.columns)


@query(
    "a36_auc",
    """s AS (SELECT d.n_chars AS score, l.quality AS label FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY score),
b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round((sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS auc FROM b""",
)
def a36(t):
    rows = t.table("documents").select("doc_id", F.col("n_chars").alias("score")).join(
        t.table("labels").select("doc_id", F.col("quality").alias("label")), "doc_id"
    )
    return rounded(ev.auc(rows), "auc")


def _nll(temp: str) -> str:
    return f"avg(-ln(greatest(exp((x[truth + 1] - mx) / {temp}) / list_sum(list_transform(x, lambda v: exp((v - mx) / {temp}))), 1e-12)))"


GRID_SQL = ", ".join(f"{x!r}::DOUBLE" for x in ev.TEMPERATURES)


@query(
    "a37_temperature_fit",
    f"""rc AS (SELECT list_transform(embedding, lambda v: v::DOUBLE * 20) AS x, list_max(embedding)::DOUBLE * 20 AS mx, label AS truth FROM embeddings),
g AS (SELECT unnest([{GRID_SQL}]) AS tp),
c1 AS (SELECT tp, {_nll('tp')} AS nll FROM rc CROSS JOIN g GROUP BY tp),
b1 AS (SELECT arg_min(tp, nll) AS b FROM c1),
g2 AS (SELECT b / 2 + i * (b * 1.5 / 199) AS tp FROM b1 CROSS JOIN range(200) r(i)),
c2 AS (SELECT tp, {_nll('tp')} AS nll FROM rc CROSS JOIN g2 GROUP BY tp)
SELECT round(arg_min(tp, nll), 6) AS temperature, round(min(nll), 6) AS nll FROM c2""",
)
def a37(t):
    logits = F.transform("embedding", lambda v: v.cast("double") * 20)
    records = t.table("embeddings").select(logits.alias("logits"), F.col("label").alias("truth"))
    return rounded(ev.fit_temperature(records), "temperature", "nll")


@query(
    "f13_r19_confidence_signals",
    """x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 20) AS l, list_max(embedding)::DOUBLE * 20 AS mx FROM embeddings),
e AS (SELECT *, list_transform(l, lambda v: exp(v - mx)) AS ex FROM x),
p AS (SELECT *, list_transform(ex, lambda v: v / list_sum(ex)) AS pr FROM e),
s AS (SELECT *, list_reverse_sort(l) AS sl, list_reverse_sort(pr) AS sp FROM p)
SELECT vec_id, round((sl[1] - sl[2]) / greatest(sl[1] - list_min(l), 1e-9), 6) AS logit_margin, round((sp[1] - sp[2]) / greatest(sp[1] - list_min(pr), 1e-9), 6) AS prob_margin,
  round(1 - list_sum(list_transform(pr, lambda v: -v * ln(greatest(v, 1e-12)))) / ln(len(l)), 6) AS conf_entropy, round(sp[1], 6) AS top_prob,
  round((list_cosine_similarity(l[1:21], l[22:42]) + list_cosine_similarity(l[1:21], l[43:63]) + list_cosine_similarity(l[22:42], l[43:63])) / 3, 6) AS agreement FROM s""",
)
def r19(t):
    rows = t.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 20).alias("l"))
    parts = [F.slice("l", i, 21) for i in (1, 22, 43)]
    agree = (ev.cosine(parts[0], parts[1]) + ev.cosine(parts[0], parts[2]) + ev.cosine(parts[1], parts[2])) / 3
    out = ev.confidence(rows, "l").withColumn("agreement", agree).drop("l")
    return rounded(out, *out.columns[1:])


@query(
    "f1_min_max_normalisation",
    """x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS l FROM embeddings)
SELECT vec_id, CAST(i AS INTEGER) AS pos, round((l[i + 1] - list_min(l)) / nullif(list_max(l) - list_min(l), 0), 6) AS value FROM x, range(64) r(i)""",
)
def f1(t):
    rows = t.table("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("l"))
    out = ev.min_max_scaled(rows, "l").select("vec_id", F.posexplode("l").alias("pos", "value"))
    return out.withColumn("value", r6("value"))


# -- text quality --------------------------------------------------------------------------------

PAIRS = """
pairs AS (SELECT u.conv_id * 1000 + u.turn AS pair_id, u.text AS hypothesis, a.text AS reference FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
tok AS (SELECT pair_id, list_filter(string_split(trim(lower(regexp_replace(hypothesis, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS h,
  list_filter(string_split(trim(lower(regexp_replace(reference, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '') AS r FROM pairs)
"""


def text_pairs(t):
    """Each user turn as hypothesis with the assistant turn after it as reference."""
    c = t.table("conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("hypothesis"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "hypothesis", "reference"
    )


BLEU = PAIRS.rstrip() + """,
gr0 AS (SELECT pair_id, 1 AS hyp, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS gram FROM tok, range(1, 5) q(n) WHERE len(h) >= n
  UNION ALL SELECT pair_id, 0, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) FROM tok, range(1, 5) q(n) WHERE len(r) >= n),
gc AS (SELECT pair_id, n, gram, sum(hyp) AS h, sum(1 - hyp) AS r FROM gr0 GROUP BY ALL),
gn AS (SELECT pair_id, n, sum(least(h, r)) AS clipped, sum(h) AS total FROM gc GROUP BY ALL),
gl AS (SELECT pair_id, count(*) AS k, sum(ln(clipped::DOUBLE / total::DOUBLE)) AS s FROM gn WHERE clipped > 0 GROUP BY 1),
bl AS (SELECT tok.pair_id, CASE WHEN len(h) > 0 AND k = 4 THEN least(1.0, exp(1 - len(r) / greatest(len(h), 1))) * exp(s / 4) ELSE 0.0 END AS bleu4 FROM tok LEFT JOIN gl USING (pair_id))
"""


@query("f8_bleu4", BLEU + "SELECT pair_id, round(bleu4, 6) AS bleu4 FROM bl")
def f8(t):
    return rounded(quality.bleu4(text_pairs(t)), "bleu4")


@query("f9_rouge_l")
def f9(t):
    return quality.rouge_l(text_pairs(t))


@query(
    "a44_text_quality",
    BLEU + "SELECT CASE WHEN c.turn = 0 THEN 'first' ELSE 'later' END AS expert, count(*) AS n, round(avg(bleu4), 6) AS mean_bleu4 FROM bl JOIN conversations c ON c.conv_id * 1000 + c.turn = bl.pair_id GROUP BY 1",
)
def a44(t):
    scores = quality.bleu4(text_pairs(t))
    expert = F.when(F.col("pair_id") % 1000 == 0, "first").otherwise("later")
    return scores.groupBy(expert.alias("expert")).agg(F.count("*").alias("n"), r6(F.avg("bleu4"), "mean_bleu4"))


@query("j16_text_pairs", PAIRS + "SELECT pair_id, length(hypothesis) AS h_chars, length(reference) AS r_chars FROM pairs")
def j16(t):
    return text_pairs(t).select(
        "pair_id", F.length("hypothesis").cast("long").alias("h_chars"), F.length("reference").cast("long").alias("r_chars")
    )


@query(
    "a41_usable_split_point",
    """d AS (SELECT ts // 86400 AS day, count(DISTINCT trace_id) AS usable FROM spans GROUP BY 1),
r AS (SELECT day, usable, sum(usable) OVER (ORDER BY day) AS running, sum(usable) OVER () AS total FROM d)
SELECT min(day) AS split_day, CAST(min(running) AS BIGINT) AS usable_before FROM r WHERE running >= 0.2 * total""",
)
def a41(t):
    days = t.spans.select(F.expr("ts div 86400").alias("day"), "trace_id").distinct().groupBy("day").agg(
        F.count("*").alias("usable")
    )
    total = days.agg(F.sum("usable")).scalar()
    running = global_running_sum(days, ["day"], "usable", "before").withColumn(
        "running", F.col("before") + F.col("usable")
    )
    reached = running.filter(F.col("running") >= 0.2 * total)
    return reached.agg(F.min("day").alias("split_day"), F.min("running").alias("usable_before"))


@query(
    "u5_union_of_runs",
    """r AS (SELECT user_id AS case_id, 0 AS run, us, event_id, service AS predicted FROM ev WHERE event_type = 'click'
  UNION ALL SELECT user_id, 1, us, event_id, service || '-b' FROM ev WHERE event_type = 'view')
SELECT case_id, arg_max(predicted, {'a': run, 'b': us, 'c': event_id}) AS predicted, count(*) AS n FROM r GROUP BY 1""",
)
def u5(t):
    e = t.events
    first = e.filter("event_type = 'click'").select(F.col("user_id").alias("case_id"), F.lit(0).alias("run"), "us", "event_id", F.col("service").alias("predicted"))
    resumed = e.filter("event_type = 'view'").select(F.col("user_id").alias("case_id"), F.lit(1).alias("run"), "us", "event_id", F.concat("service", F.lit("-b")).alias("predicted"))
    return first.unionByName(resumed).groupBy("case_id").agg(
        F.max_by("predicted", F.struct("run", "us", "event_id")).alias("predicted"), F.count("*").alias("n")
    )


@query(
    "u6_common_keys",
    """SELECT DISTINCT ts // 60 % 1440 AS minute FROM ev WHERE event_type = 'click' INTERSECT SELECT DISTINCT fault_ts // 60 % 1440 FROM incidents""",
)
def u6(t):
    run = t.events.filter("event_type = 'click'").select(F.expr("ts div 60 % 1440").alias("minute"))
    return run.intersect(t.incidents.select(F.expr("fault_ts div 60 % 1440").alias("minute")))


@query(
    "a40_label_summary",
    "SELECT quality, toxic, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS split, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
)
def a40(t):
    split = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    return t.table("labels").join(t.table("documents").select("doc_id", split.alias("split")), "doc_id").groupBy(
        "quality", "toxic", "split"
    ).agg(F.count("*").alias("n"))


@query(
    "j14_candidate_match",
    TRUTH
    + """SELECT t.incident_id, w.name, bool_or(contains(lower(w.name), lower(c.c)) OR contains(lower(c.c), lower(w.name))) AS is_match
FROM truth t JOIN cand c USING (incident_id) JOIN (SELECT DISTINCT incident_id, ' ' || upper(service) AS raw, upper(service) AS name FROM win_spans) w ON w.incident_id = t.incident_id GROUP BY ALL""",
)
def j14(t):
    seen = t.window_spans.select("incident_id", F.upper("service").alias("name")).distinct()
    return seen.join(truths(t).select("incident_id", "candidates"), "incident_id").select(
        "incident_id", "name", ev.is_match(F.concat(F.lit(" "), "name"), F.col("candidates")).alias("is_match")
    )
