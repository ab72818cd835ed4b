"""Queries on ranked lists, scenarios and fusion.

The sources are orderings per incident: spans in the wide window give the anchor (longest span)
and trace (failed spans) lists, metric windows give the two metric channels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.numbers import r6
from faultline.operators import causal, detect, fusion, ranking
from faultline.plans.registry import query
from faultline.plans.scores import MULTI, TRAIN, eta_channels
from faultline.plans.windows import metric_windows
from faultline.session import cut_lineage

# -- shared inputs ------------------------------------------------------------------------------

LISTS = MULTI.rstrip() + """,
agg AS (SELECT incident_id, service, max(duration) AS longest, CAST(sum(status) AS BIGINT) AS errors, count(*) AS n FROM win_spans GROUP BY ALL),
anchor AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY longest DESC, service) AS rank FROM agg),
trace AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY errors DESC, n DESC, service) AS rank FROM agg),
chan AS (SELECT incident_id, metric, round(eta, 6) AS g_uni, round(eta_multi, 6) AS g_multi FROM em),
uni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY g_uni DESC, metric) AS rank FROM chan) WHERE rank <= 5),
multi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY g_multi DESC, metric) AS rank FROM chan) WHERE rank <= 5),
flags AS (SELECT incident_id, (SELECT count(*) > 7 FROM chan c WHERE c.incident_id = i.incident_id AND g_uni > 0) AS uni_flag,
  (SELECT count(*) >= 2 FROM ss WHERE ss.incident_id = i.incident_id AND anomalous) AS multi_flag FROM incidents i),
tops AS (SELECT f.*, (SELECT list(metric ORDER BY rank) FROM uni u WHERE u.incident_id = f.incident_id) AS ul,
  (SELECT list(metric ORDER BY rank) FROM multi m WHERE m.incident_id = f.incident_id) AS ml FROM flags f),
scen AS (SELECT *, CASE WHEN multi_flag AND NOT uni_flag THEN 'multi_anom_single_normal' WHEN uni_flag AND NOT multi_flag THEN 'single_anom_multi_normal'
  WHEN uni_flag AND multi_flag AND len(list_intersect(ml, ul)) < 2 THEN 'both_anom_different_root' ELSE 'consistent' END AS scenario FROM tops)
"""


def span_lists(t):
    agg = t.window_spans.groupBy("incident_id", "service").agg(
        F.max("duration").alias("longest"), F.sum("status").alias("errors"), F.count("*").alias("n")
    )
    if not hasattr(t, "span_lists"):
        agg = cut_lineage(agg)
        anchor = ranking.rank_within(agg, ["incident_id"], [F.desc("longest"), "service"])
        trace = ranking.rank_within(agg, ["incident_id"], [F.desc("errors"), F.desc("n"), "service"])
        t.span_lists = anchor, trace
    return t.span_lists


def channels(t):
    """Per metric both channel scores; written once, read by several lists."""
    if not hasattr(t, "channels"):
        t.channels = cut_lineage(
            eta_channels(t).select("incident_id", "metric", r6("eta", "g_uni"), r6("eta_multi", "g_multi"))
        )
    return t.channels


def channel_tops(t):
    """Per incident the two top-5 lists, the anomaly flags and the scenario."""
    if hasattr(t, "channel_tops"):
        return t.channel_tops
    ch = channels(t)
    steps = detect.step_scores(detect.z_errors(metric_windows(t), TRAIN))
    multi_flag = steps.groupBy("incident_id").agg((F.count_if("anomalous") >= 2).alias("multi_flag"))
    uni_flag = ch.groupBy("incident_id").agg((F.count_if(F.col("g_uni") > 0) > 7).alias("uni_flag"))
    uni = fusion.root_metrics(ch, "g_uni").select("incident_id", F.col("names").alias("ul"), F.col("root_text").alias("uni_text"))
    multi = fusion.root_metrics(ch, "g_multi").select("incident_id", F.col("names").alias("ml"), F.col("root_text").alias("multi_text"))
    tops = (
        t.incidents.select("incident_id")
        .join(uni, "incident_id", "left")
        .join(multi, "incident_id", "left")
        .join(uni_flag, "incident_id", "left")
        .join(multi_flag, "incident_id", "left")
        .withColumn("uni_flag", F.coalesce("uni_flag", F.lit(False)))
        .withColumn("multi_flag", F.coalesce("multi_flag", F.lit(False)))
    )
    kind = fusion.scenario(F.col("multi_flag"), F.col("uni_flag"), F.col("ml"), F.col("ul"))
    t.channel_tops = cut_lineage(tops.withColumn("scenario", kind))
    return t.channel_tops


def dual_list(t):
    """The final metric ranking as rows: the univariate list, or the multivariate one where it counts."""
    tops = channel_tops(t)
    picked = F.when(F.col("scenario") == fusion.CONSISTENT, F.col("ul")).otherwise(F.col("ml"))
    rows = tops.select("incident_id", F.posexplode(picked).alias("_i", "metric"))
    return rows.select("incident_id", "metric", (F.col("_i") + 1).alias("rank"))


def gammas(t):
    return channels(t).select("incident_id", "metric", F.col("g_multi").alias("gamma"))


DUAL = LISTS.rstrip() + """,
dual AS (SELECT scen.incident_id, u.metric, u.rank FROM scen JOIN uni u USING (incident_id) WHERE scenario = 'consistent'
  UNION ALL SELECT scen.incident_id, m.metric, m.rank FROM scen JOIN multi m USING (incident_id) WHERE scenario <> 'consistent'),
gs AS (SELECT incident_id, split_part(metric, '_', 1) AS service, sum(g_multi) AS g FROM chan GROUP BY ALL),
gr AS (SELECT *, CASE WHEN max(g) OVER w > 0 THEN g / max(g) OVER w END AS g_rel, g > max(g) OVER w * 0.4 AS strong,
  row_number() OVER (PARTITION BY incident_id ORDER BY g DESC, service) AS rank FROM gs WINDOW w AS (PARTITION BY incident_id)),
vt AS (SELECT incident_id, service, 1.0::DOUBLE / rank AS anchor_rr, rank AS anchor_rank, NULL::DOUBLE AS trace_rr, NULL::DOUBLE AS dual_rr, NULL::DOUBLE AS g_rel, NULL::DOUBLE AS causal_rr, NULL::BOOLEAN AS strong FROM anchor WHERE rank <= 5
  UNION ALL SELECT incident_id, service, NULL, NULL, 1.0::DOUBLE / rank, NULL, NULL, NULL, NULL FROM trace WHERE rank <= 5
  UNION ALL SELECT incident_id, split_part(metric, '_', 1), NULL, NULL, NULL, 1.0::DOUBLE / rank, NULL, NULL, NULL FROM dual
  UNION ALL SELECT incident_id, service, NULL, NULL, NULL, NULL, g_rel, CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank END, strong FROM gr),
ev0 AS (SELECT incident_id, service, sum(anchor_rr) AS anchor_rr, min(anchor_rank) AS anchor_rank, sum(trace_rr) AS trace_rr, sum(dual_rr) AS dual_rr,
  max(g_rel) AS g_rel, max(causal_rr) AS causal_rr, coalesce(bool_or(strong), false) AS strong FROM vt GROUP BY ALL)
"""


def fuse_sql(params: str) -> str:
    """Fusion for a list of parameter rows, given as a SELECT."""
    return DUAL.rstrip() + f""",
par AS ({params}),
fz AS (SELECT par.*, e.*, s.scenario, CAST(anchor_rr IS NOT NULL AS INT) + CAST(trace_rr IS NOT NULL AS INT) + CAST(dual_rr IS NOT NULL AS INT) + CAST(strong AS INT) AS n_agree
  FROM ev0 e LEFT JOIN scen s USING (incident_id) CROSS JOIN par),
sx AS (SELECT *, (CASE WHEN causal_anchor THEN coalesce(causal_rr, 0) + 0.4 * coalesce(anchor_rr, 0) ELSE coalesce(anchor_rr, 0) + w_causal * coalesce(g_rel, 0) END
    + w_trace * coalesce(trace_rr, 0) + w_dual * coalesce(dual_rr, 0)) * CASE WHEN n_agree >= 2 THEN 1 + alpha * (n_agree - 1) ELSE 1.0 END
    * CASE WHEN legacy AND scenario = 'both_anom_different_root' AND anchor_rank <= 3 THEN 1.3
      WHEN legacy AND scenario = 'multi_anom_single_normal' AND strong AND anchor_rr IS NULL THEN 1.2 ELSE 1.0 END AS score FROM fz),
rb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY param_id, incident_id ORDER BY round(CAST(score AS DECIMAL(38,12)), 9) DESC, coalesce(anchor_rank, 6), service) AS rank_before FROM sx) WHERE rank_before <= 5),
pr AS (SELECT *, protect AND scenario = 'multi_anom_single_normal' AND anchor_rank IS NOT DISTINCT FROM 1 AS protected FROM rb),
fused AS (SELECT *, row_number() OVER (PARTITION BY param_id, incident_id ORDER BY protected DESC, rank_before) AS rank FROM pr)
"""


ONE = "SELECT 'default' AS param_id, 0.3::DOUBLE AS w_causal, 0.4::DOUBLE AS w_trace, 0.3::DOUBLE AS w_dual, 0.4::DOUBLE AS alpha, {c} AS causal_anchor, {p} AS protect, {l} AS legacy"


def votes(t):
    if not hasattr(t, "votes"):
        anchor, trace = span_lists(t)
        t.votes = cut_lineage(fusion.evidence(anchor, trace, gammas(t), dual_list(t)))
    return t.votes


def fused(t, params=None):
    return fusion.fuse(
        fusion.with_params(votes(t), params or [{"param_id": "default"}]), channel_tops(t)
    )


# -- channels and scenarios ----------------------------------------------------------------------


@query(
    "r2_root_metrics_text",
    LISTS
    + """SELECT incident_id, 'Top 5 root cause metrics is:' || string_agg('(' || rank || ')' || metric, ',' ORDER BY rank) || '.' AS root_text
FROM multi GROUP BY incident_id""",
)
def r2(t):
    return fusion.root_metrics(channels(t), "g_multi").select("incident_id", "root_text")


@query(
    "r4_conflict_scenario",
    LISTS + "SELECT incident_id, uni_flag, multi_flag, CAST(len(list_intersect(ml, ul)) AS INTEGER) AS shared, scenario FROM scen WHERE ml IS NOT NULL",
)
def r4(t):
    shared = F.size(F.array_intersect("ml", "ul")).alias("shared")
    return channel_tops(t).filter("ml is not null").select(
        "incident_id", "uni_flag", "multi_flag", shared, "scenario"
    )


@query(
    "r5_trusted_candidates",
    LISTS
    + """,
c AS (SELECT incident_id, scenario, metric, 0 AS src, rank FROM scen JOIN multi USING (incident_id)
  UNION ALL SELECT incident_id, scenario, metric, 1, rank FROM scen JOIN uni USING (incident_id) WHERE scenario = 'both_anom_different_root'),
d AS (SELECT incident_id, scenario, metric, min(src * 100 + rank) AS o FROM c GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY o) AS rn FROM d)
SELECT incident_id, scenario, string_agg(metric, ',' ORDER BY o) AS trusted FROM n WHERE rn <= 10 GROUP BY ALL""",
)
def r5(t):
    names = fusion.trusted(F.col("scenario"), F.col("ml"), F.col("ul"))
    return channel_tops(t).filter("ml is not null").select(
        "incident_id", "scenario", F.array_join(names, ",").alias("trusted")
    )


ARB = LISTS + """,
ab AS (SELECT em.incident_id, em.metric, round((eta + eta_multi) / 2 * CASE WHEN u.metric IS NOT NULL AND m.metric IS NOT NULL THEN 2.0
    WHEN u.metric IS NOT NULL OR m.metric IS NOT NULL THEN 1.5 ELSE 1.0 END, 6) AS boosted
  FROM em LEFT JOIN uni u USING (incident_id, metric) LEFT JOIN multi m ON m.incident_id = em.incident_id AND m.metric = em.metric)
"""


def arbitrated(t):
    both = eta_channels(t).join(channel_tops(t).select("incident_id", "ul", "ml"), "incident_id")
    boost = fusion.arbitration_boost(F.col("metric"), F.col("ml"), F.col("ul"))
    value = (F.col("eta") + F.col("eta_multi")) / 2 * boost
    return both.select("incident_id", "metric", r6(value, "boosted"))


@query("r6_arbitration_boost", ARB + "SELECT * FROM ab")
def r6_boost(t):
    return arbitrated(t)


@query(
    "r7_final_metric_ranking",
    ARB
    + """,
tx AS (SELECT 'u' AS c, incident_id, string_agg('(' || rank || ')' || metric, ',' ORDER BY rank) AS s FROM uni GROUP BY ALL
  UNION ALL SELECT 'm', incident_id, string_agg('(' || rank || ')' || metric, ',' ORDER BY rank) FROM multi GROUP BY ALL
  UNION ALL SELECT 'a', incident_id, string_agg('(' || rank || ')' || metric, ',' ORDER BY rank) FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY boosted DESC, metric) AS rank FROM ab) WHERE rank <= 5 GROUP BY ALL)
SELECT scen.incident_id, scenario, 'Top 5 root cause metrics is:' || s || '.' || CASE WHEN scenario = 'single_anom_multi_normal' THEN '"""
    + fusion.SUPPLEMENT
    + """' ELSE '' END AS final_text
FROM scen JOIN tx ON tx.incident_id = scen.incident_id AND c = CASE scenario WHEN 'consistent' THEN 'u' WHEN 'both_anom_different_root' THEN 'a' ELSE 'm' END""",
)
def r7(t):
    arb = fusion.root_metrics(arbitrated(t), "boosted").select("incident_id", F.col("root_text").alias("arb"))
    text = fusion.final_root_text(F.col("scenario"), F.col("uni_text"), F.col("multi_text"), F.col("arb"))
    return (
        channel_tops(t).join(arb, "incident_id").select("incident_id", "scenario", text.alias("final_text"))
    )


@query(
    "r3_fallback_gamma",
    LISTS + "SELECT incident_id, metric, abs(g_uni) AS gamma FROM chan",
)
def r3(t):
    # no walk at all: the visits are empty and the ranking falls back to abs(eta)
    none = t.spark.createDataFrame([], "incident_id long, node string, visits double")
    eta = channels(t).select("incident_id", "metric", F.col("g_uni").alias("eta"))
    return causal.gamma(none, eta).select("incident_id", "metric", "gamma")


@query(
    "r22_concordance",
    LISTS
    + """SELECT incident_id, CASE WHEN ul IS NULL THEN 'none' WHEN ml IS NULL THEN 'univariate only' WHEN ul[1] = ml[1] THEN 'same' ELSE 'different' END AS concordance FROM scen""",
)
def r22(t):
    return channel_tops(t).select(
        "incident_id", fusion.concordance(F.col("uni_text"), F.col("multi_text")).alias("concordance")
    )


# -- fusion --------------------------------------------------------------------------------------

FUSE_OUT = "SELECT incident_id, service, CAST(n_agree AS INTEGER) AS n_agree, round(score, 6) AS score, rank_before, protected, rank FROM fused"


def fuse_out(df):
    return df.select("incident_id", "service", "n_agree", r6("score", "score"), "rank_before", "protected", "rank")


@query("r8_confidence_vote_fusion", fuse_sql(ONE.format(c="false", p="true", l="false")) + FUSE_OUT)
def r8(t):
    return fuse_out(fused(t))


@query("r9_causal_anchor_fusion", fuse_sql(ONE.format(c="true", p="true", l="false")) + FUSE_OUT)
def r9(t):
    return fuse_out(fused(t, [{"causal_anchor": True}]))


@query("r12_scenario_boosts", fuse_sql(ONE.format(c="false", p="true", l="true")) + FUSE_OUT)
def r12(t):
    return fuse_out(fused(t, [{"legacy": True}]))


@query(
    "r11_anchor_protection",
    fuse_sql(ONE.format(c="false", p="true", l="false"))
    + "SELECT incident_id, arg_min(service, rank_before) AS before, arg_min(service, rank) AS after, bool_or(protected AND rank_before <> 1) AS changed FROM fused GROUP BY 1",
)
def r11(t):
    return fused(t).groupBy("incident_id").agg(
        F.min_by("service", "rank_before").alias("before"),
        F.min_by("service", "rank").alias("after"),
        F.bool_or(F.col("protected") & (F.col("rank_before") != 1)).alias("changed"),
    )


@query(
    "r10_strong_causal_services",
    DUAL + "SELECT incident_id, service, round(g, 6) AS g, round(g_rel, 6) AS g_rel FROM gr WHERE strong",
)
def r10(t):
    return fusion.service_gamma(gammas(t)).filter("strong").select(
        "incident_id", "service", r6("g", "g"), r6("g_rel", "g_rel")
    )


@query(
    "r13_best_metric_per_service",
    fuse_sql(ONE.format(c="false", p="true", l="false"))
    + """SELECT fused.incident_id, service, rank, (SELECT metric FROM chan c WHERE c.incident_id = fused.incident_id AND split_part(metric, '_', 1) = service ORDER BY g_multi DESC, metric LIMIT 1) AS metric
FROM fused WHERE service IN (SELECT split_part(metric, '_', 1) FROM chan c WHERE c.incident_id = fused.incident_id)""",
)
def r13(t):
    return fusion.best_metric(fused(t), gammas(t)).select("incident_id", "service", "rank", "metric")


def four_lists(t):
    anchor, trace = span_lists(t)
    causal = ranking.rank_within(fusion.service_gamma(gammas(t)), ["incident_id"], [F.desc("g"), "service"])
    dual = dual_list(t).withColumn("service", fusion.service_of(F.col("metric")))
    out = None
    for rows in (anchor, trace, causal, dual):
        rows = rows.filter("rank <= 5").select("incident_id", "service", F.col("rank").cast("long").alias("rank"))
        out = rows if out is None else out.unionByName(rows)
    return out


RRF = DUAL.rstrip() + """,
four AS (SELECT incident_id, service, rank FROM anchor WHERE rank <= 5 UNION ALL SELECT incident_id, service, rank FROM trace WHERE rank <= 5
  UNION ALL SELECT incident_id, service, rank FROM gr WHERE rank <= 5 UNION ALL SELECT incident_id, split_part(metric, '_', 1), rank FROM dual),
rrf0 AS (SELECT incident_id, service, sum(1.0::DOUBLE / (60 + rank)) AS score FROM four GROUP BY ALL),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY round(CAST(score AS DECIMAL(38,12)), 9) DESC, service) AS rank FROM rrf0) WHERE rank <= 5)
"""


@query("r14_reciprocal_rank_fusion", RRF + "SELECT incident_id, service, round(score, 6) AS score, rank FROM rrf")
def r14(t):
    return fusion.reciprocal_rank_fusion(four_lists(t)).withColumn("score", r6("score"))


@query(
    "r15_gamma_proxy",
    LISTS + "SELECT incident_id, metric, CASE rank WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.6::DOUBLE WHEN 4 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END AS gamma FROM uni",
)
def r15(t):
    # weights by position of the names parsed back from the ranking text
    weights = F.array(*map(F.lit, fusion.PROXY_WEIGHTS))
    names = fusion.parse_root_text(F.col("uni_text"))
    rows = channel_tops(t).select("incident_id", F.posexplode(names).alias("_i", "metric"))
    return rows.select("incident_id", "metric", F.get(weights, F.col("_i")).alias("gamma"))


@query(
    "f5_parse_root_text",
    LISTS + "SELECT incident_id, CAST(rank AS INTEGER) AS pos, metric FROM uni",
)
def f5(t):
    names = fusion.parse_root_text(F.col("uni_text"))
    rows = channel_tops(t).select("incident_id", F.posexplode(names).alias("_i", "metric"))
    return rows.select("incident_id", (F.col("_i") + 1).alias("pos"), "metric")


@query(
    "r18_signal_quality",
    """agg AS (SELECT incident_id, service, max(duration) AS s FROM win_spans GROUP BY ALL),
l AS (SELECT incident_id, list(s ORDER BY s DESC) AS v FROM agg GROUP BY 1)
SELECT incident_id, round(CASE WHEN len(v) < 2 THEN 0.5 WHEN v[1] - v[-1] <= 1e-9 THEN 0.0
  ELSE greatest(0.0, least(1.0, (v[1] - v[2]) / (v[1] - v[-1]))) END, 6) AS q_anchor, 0.5::DOUBLE AS q_causal FROM l""",
)
def r18(t):
    anchor, _ = span_lists(t)
    scores = anchor.groupBy("incident_id").agg(F.collect_list("longest").alias("v"))
    return scores.select(
        "incident_id", r6(fusion.signal_quality(F.col("v")), "q_anchor"),
        F.lit(0.5).alias("q_causal"),  # R27: a neutral prior by design
    )


@query(
    "r23_metrics_of_top_services",
    DUAL
    + """SELECT * FROM (SELECT c.incident_id, c.metric, row_number() OVER (PARTITION BY c.incident_id ORDER BY gr.rank, g_multi DESC, metric) AS rank
FROM chan c JOIN gr ON gr.incident_id = c.incident_id AND gr.service = split_part(c.metric, '_', 1)) WHERE rank <= 5""",
)
def r23(t):
    services = ranking.rank_within(
        fusion.service_gamma(gammas(t)), ["incident_id"], [F.desc("g"), "service"], "service_rank"
    )
    named = gammas(t).withColumn("service", fusion.service_of(F.col("metric")))
    joined = named.join(services.select("incident_id", "service", "service_rank"), ["incident_id", "service"])
    return ranking.rank_within(
        joined, ["incident_id"], ["service_rank", F.desc("gamma"), "metric"]
    ).filter("rank <= 5").select("incident_id", "metric", "rank")


U_SQL = DUAL.rstrip() + """,
a AS (SELECT incident_id, service FROM anchor WHERE rank <= 5), b AS (SELECT incident_id, service FROM trace WHERE rank <= 5)
"""


def two_lists(t):
    anchor, trace = span_lists(t)
    names = lambda df, n: df.filter("rank <= 5").groupBy("incident_id").agg(fusion.names_in_order(name="service").alias(n))
    return names(anchor, "a").join(names(trace, "b"), "incident_id")


@query(
    "u1_u4_ordered_union",
    DUAL
    + """,
c AS (SELECT incident_id, service, min(o) AS o FROM (SELECT incident_id, service, rank AS o FROM anchor WHERE rank <= 5
  UNION ALL SELECT incident_id, service, 100 + rank FROM trace WHERE rank <= 5) GROUP BY ALL)
SELECT incident_id, string_agg(service, ',' ORDER BY o) AS merged FROM c GROUP BY 1""",
)
def u1(t):
    merged = F.array_join(F.array_distinct(F.concat("a", "b")), ",")
    return two_lists(t).select("incident_id", merged.alias("merged"))


@query(
    "u2_intersection_size",
    U_SQL + "SELECT a.incident_id, CAST(count(b.service) AS INTEGER) AS shared FROM a LEFT JOIN b USING (incident_id, service) GROUP BY 1",
)
def u2(t):
    return two_lists(t).select("incident_id", F.size(F.array_intersect("a", "b")).alias("shared"))


@query(
    "u3_difference",
    U_SQL + "SELECT a.incident_id, string_agg(a.service, ',' ORDER BY a.service) AS only_anchor FROM a ANTI JOIN b USING (incident_id, service) GROUP BY 1",
)
def u3(t):
    only = F.array_sort(F.array_except("a", "b"))
    return two_lists(t).filter(F.size(only) > 0).select(
        "incident_id", F.array_join(only, ",").alias("only_anchor")
    )
