"""Queries that train and apply classifiers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from faultline.functions.numbers import r6
from faultline.operators import detect, learn, ranking
from faultline.operators import series as se
from faultline.operators import spans as sp
from faultline.operators.graphs import neighbour_mean
from faultline.plans import evaluate, rankings
from faultline.plans.causal import service_graph
from faultline.plans.evaluate import SPLIT_DAY
from faultline.plans.registry import query
from faultline.plans.scores import TRAIN
from faultline.plans.traces import SERVICES
from faultline.plans.windows import metric_windows
from faultline.session import cut_lineage

FIELDS = [f"{s}_{f}" for s in SERVICES for f in ("duration", "status", "self_time")]


def labelled_traces(t):
    """Trace vectors of all incident windows with label (fault service visited) and root service."""
    if not hasattr(t, "labelled_traces"):
        vectors = sp.trace_vectors(sp.timed_paths(t.spans), SERVICES)
        visits = t.window_spans.groupBy("incident_id", "trace_id").agg(
            F.max((F.col("service") == F.col("fault_service")).cast("double")).alias("label"),
            F.min("fault_service").alias("root"),
        )
        rows = visits.join(vectors, "trace_id").join(t.incidents.select("incident_id", "day"), "incident_id")
        t.labelled_traces = cut_lineage(learn.assemble(rows, ["n_services", "visited", *FIELDS]))
    return t.labelled_traces


@query("m1_trace_classifier")
def m1(t):
    rows = labelled_traces(t)
    model = learn.forest(rows.filter(F.col("day") < SPLIT_DAY), "label")
    held = model.transform(rows.filter(F.col("day") >= SPLIT_DAY))
    return held.select(
        "incident_id", "trace_id", "label", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("p_anomalous")
    )


@query("m2_m4_a17_root_service_ranking")
def m2(t):
    rows = labelled_traces(t)
    abnormal = rows.filter("label = 1")
    model, labels = learn.root_classifier(
        abnormal.filter(F.col("day") < SPLIT_DAY), "root", 2 + len(FIELDS)
    )
    scored = model.transform(abnormal.filter(F.col("day") >= SPLIT_DAY))
    return learn.class_probability_sum(scored, labels, ["incident_id"])


@query("m5_reduced_embeddings")
def m5(t):
    rows = t.table("embeddings").select(
        "vec_id", "label", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")
    )
    out = learn.reduced(rows.filter("label <> 9"), rows, 16)
    return out.select("vec_id", F.size("embedding").alias("dim"), F.get("embedding", F.lit(0)).alias("first"))


@query("m6_reconstruction_scores")
def m6(t):
    z = se.zscore(metric_windows(t), ["incident_id", "metric"], F.expr(TRAIN))
    # the metric names are the columns of the vectors, at most MAX_METRICS of them
    names = [r["metric"] for r in t.metrics.select("metric").distinct().orderBy("metric").collect()]
    cells = F.map_from_entries(F.collect_list(F.struct("metric", "z")))
    steps = z.groupBy("incident_id", "k").agg(cells.alias("m"))
    values = F.array(*[F.coalesce(F.element_at("m", F.lit(n)), F.lit(0.0)) for n in names])
    rows = cut_lineage(steps.select("incident_id", "k", values.alias("z")))
    errors = learn.reconstruction_errors(rows, F.expr(TRAIN), names, 5)
    return detect.step_scores(errors)


@query("m7_m8_pattern_forest")
def m7(t):
    made = learn.synthetic_patterns(t.spark)
    train = learn.window_vectors(made, ["id", "class_no"])
    model = learn.forest(train, "class_no", trees=20, depth=8)
    real = learn.window_vectors(metric_windows(t), ["incident_id", "metric"])
    return model.transform(real).select("incident_id", "metric", F.col("prediction").cast("long").alias("class_no"))


@query("m9_router")
def m9(t):
    feats = ["nodes", "uniq", "in_fused", "anchor_pos"]
    rows = evaluate.router_rows(t).filter("label is not null").withColumn(
        "in_fused", F.col("anchor_in_fused").cast("int")
    )
    rows = learn.stratified_folds(learn.assemble(rows, feats).withColumn("label", F.col("label").cast("double")), "label", "incident_id")
    rows = cut_lineage(rows.select("incident_id", "features", "label", "fold"))
    hit = F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy")
    out = None
    for name, make in (
        ("logistic", lambda d: learn.logistic(d, "label")),
        ("forest", lambda d: learn.forest(d, "label")),
    ):
        part = learn.cross_validate(rows, make, "label").agg(hit).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    base = learn.majority_share(rows, "label").select(F.col("majority").alias("accuracy"), F.lit("majority").alias("model"))
    return out.unionByName(base)


@query(
    "m10_time_splits",
    f"""SELECT incident_id, CASE WHEN day >= {SPLIT_DAY} THEN 'test' ELSE 'train' END AS by_date,
  CASE WHEN row_number() OVER (ORDER BY fault_ts DESC, incident_id DESC) <= 40 THEN 'tail' ELSE 'train' END AS split FROM incidents""",
)
def m10(t):
    rows = t.incidents.select(
        "incident_id", "fault_ts", F.when(F.col("day") >= SPLIT_DAY, "test").otherwise("train").alias("by_date")
    )
    return learn.time_tail(rows, ["fault_ts", "incident_id"]).select("incident_id", "by_date", "split")


@query("m13_anchor_ranking")
def m13(t):
    nodes, edges = service_graph(t)
    feats = neighbour_mean(nodes, edges, ["f1", "f2"])
    labels = t.incidents.select("incident_id", "day", F.col("service").alias("root"))
    rows = feats.join(labels, "incident_id").withColumn("label", (F.col("node") == F.col("root")).cast("double"))
    rows = cut_lineage(learn.assemble(rows, ["n", "f1", "f2", "nf1", "nf2"]))
    model = learn.logistic(rows.filter(F.col("day") < SPLIT_DAY), "label")
    score = F.get(vector_to_array("probability"), F.lit(1))
    scored = model.transform(rows.filter(F.col("day") >= SPLIT_DAY)).withColumn("score", score)
    return ranking.rank_within(scored, ["incident_id"], [F.desc("score"), "node"]).select(
        "incident_id", F.col("node").alias("service"), r6("score", "score"), "rank"
    )
