"""Links between metrics, the walk over them, and paths.

Everything is a table: series are rows of a bounded window, links and moves are edges, and walks are rounds of
message passing over them. Python sees rows of one pair of series, in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import messages
from faultline.operators.scale import replicated, salted, top_k
from faultline.operators.vectors import partial_correlation, products, same_length, unit_rows
from faultline.session import cut_lineage

# fixed values
MAX_METRICS = 120
MAX_LAG = 10
CRITICAL_Z = 1.959964  # two-sided 5%
BACKWARD = 0.2
WALKS = 1000
WALK_STEPS = 15
SERVICE_RHO = 0.5
SERVICE_ROUNDS = 50
MAX_COVARIATES = 5

#: series of one incident that meet the others in one task; an incident with more is dealt out over several
PAIR_BLOCK = 256


def prune_metrics(metrics: DataFrame, is_service, limit: int = MAX_METRICS) -> DataFrame:
    """At most ``limit`` metrics per incident: service metrics first, then the others by name."""
    order = [F.when(is_service, 0).otherwise(1), "metric"]
    return top_k(metrics, ["incident_id"], order, limit, "pos")


def series_vectors(series: DataFrame) -> tuple[DataFrame, int]:
    """(incident_id, metric, v): the values of every bounded series by position; and the series of the largest
    incident."""
    points = F.array_sort(F.collect_list(F.struct("k", "value")))
    rows = cut_lineage(series.groupBy("incident_id", "metric").agg(points["value"].alias("v")))
    return rows, rows.groupBy("incident_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def series_pairs(rows: DataFrame, most: int) -> DataFrame:
    """(incident_id, src, x, dst, y): every two series of an incident, each with itself too.

    ``most`` is the number of series of the largest incident. An incident with very many is dealt out: its targets
    over as many parts as it needs, its sources to each of them.
    """
    salts = max(1, math.ceil(most / PAIR_BLOCK))
    left = rows.select("incident_id", F.col("metric").alias("dst"), F.col("v").alias("y"))
    right = rows.select("incident_id", F.col("metric").alias("src"), F.col("v").alias("x"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = salted(left, salts).join(replicated(right, salts).hint("shuffle_hash"), ["incident_id", "_salt"])
    return pairs.select("incident_id", "src", "x", "dst", "y").repartition(n, "incident_id", "dst")


def correlations(series: DataFrame, zero_diagonal: bool = True) -> DataFrame:
    """Correlation of every pair of an incident's metrics; undefined values are 0."""
    r = F.coalesce(partial_correlation(F.col("x"), F.col("y")), F.lit(0.0))
    if zero_diagonal:
        r = F.when(F.col("src") == F.col("dst"), 0.0).otherwise(r)
    return series_pairs(*series_vectors(series)).select("incident_id", F.col("dst").alias("a"), F.col("src").alias("b"), r.alias("r"))


def fisher_z(r: Column, freedom: Column) -> Column:
    """abs of Fisher's z over its standard error 1 / sqrt(freedom); null where that is undefined."""
    r = F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return F.when(freedom > 0, F.abs(F.atanh(r)) * F.sqrt(freedom.cast("double")))


def lagged_links(
    series: DataFrame,
    max_lag: int = MAX_LAG,
    critical: float = CRITICAL_Z,
    as_coded: bool = False,
    first_targets: int | None = None,
) -> DataFrame:
    """Links src -> dst (cause to effect) by one fixed condition: a lagged correlation that stays significant when
    the target's previous value is partialled out. ``condition_set_links`` searches the conditions instead.

    ``as_coded`` stores effect to cause instead; ``first_targets`` restricts the effects to the
    first metrics by name.
    """
    rows, most = series_vectors(series)
    pairs = series_pairs(rows, most).filter("src <> dst")
    if first_targets is not None:
        first = top_k(rows.select("incident_id", F.col("metric").alias("dst")), ["incident_id"], ["dst"], first_targets).drop("rank")
        pairs = pairs.join(first, ["incident_id", "dst"])

    @F.pandas_udf("struct<r: array<double>, partial: array<double>>")
    def tests(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = np.full((2, len(x), max_lag), np.nan)
        for places, (a, b) in same_length(x, y):
            size = a.shape[1]
            for lag in range(1, min(max_lag, size - 5) + 1):
                src, dst, own = unit_rows(a[:, : size - lag]), unit_rows(b[:, lag:]), unit_rows(b[:, lag - 1 : size - 1])
                r, r_own, past = products(src, dst), products(src, own), products(own, dst)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[:, places, lag - 1] = r, (r - r_own * past) / np.sqrt((1 - r_own**2) * (1 - past**2))
        return pd.DataFrame({"r": list(out[0]), "partial": list(out[1])})

    found = pairs.select("incident_id", "src", "dst", F.size("y").alias("n"), tests("x", "y").alias("t"))
    found = found.select("incident_id", "src", "dst", "n", F.posexplode(F.arrays_zip("t.r", "t.partial")).alias("lag", "t"))
    found = found.select("incident_id", "src", "dst", F.col("n") - F.col("lag") - 1, (F.col("lag") + 1).cast("long").alias("lag"), "t.r", "t.partial").toDF(
        "incident_id", "src", "dst", "n", "lag", "r", "partial"
    )
    strong = (fisher_z(F.col("r"), F.col("n") - 3) > critical) & (fisher_z(F.col("partial"), F.col("n") - 4) > critical)
    src, dst = ("dst", "src") if as_coded else ("src", "dst")
    return found.filter(strong).select("incident_id", F.col(src).alias("src"), F.col(dst).alias("dst"), "lag", "r", "partial")


def condition_set_links(
    series: DataFrame,
    max_lag: int = MAX_LAG,
    critical: float = CRITICAL_Z,
    max_order: int | None = None,
) -> DataFrame:
    """Links src -> dst (cause to effect) that no set of the target's other parents explains.

    Level 0 takes as parents of a target all lagged metrics, its own past among them, whose correlation is
    significant (Fisher z). Level k tests every parent given the k strongest other parents of the target, by
    partial correlation of order k, and drops it when it is no longer significant. A parent's strength is the
    smallest absolute value it has had in a test. The search ends when no target has more than k parents left,
    when the points are too few, or after ``max_order``. All correlations are over the same points, those that
    have every lag. ``partial`` and ``n_conditions`` are from a link's last test; own lags serve as conditions
    only. A constant series has no links.

    Candidates are rows, dealt out by target. A level ranks them, hands each target's k + 1 strongest back to all
    (k + 1 vectors of one window, never all of them) and is written to the shared folder. The points of a window
    bound the order, and so the vectors in a row.
    """
    rows, most = series_vectors(series)

    def reach(size):
        return max(min(max_lag, size - 5), 0)

    @F.pandas_udf("array<double>")
    def by_lag(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full((len(x), max_lag), np.nan)
        for places, (a, b) in same_length(x, y):
            size = a.shape[1]
            most = reach(size)
            dst = unit_rows(b[:, most:])
            for lag in range(1, most + 1):
                out[places, lag - 1] = products(unit_rows(a[:, most - lag : size - lag]), dst)
        return pd.Series(list(out))

    span = F.greatest(F.least(F.lit(max_lag), F.size("y") - 5), F.lit(0))
    columns = ["incident_id", "dst", "src", "lag", "n", "x", "y"]
    found = series_pairs(rows, most).select("*", by_lag("x", "y").alias("rs"), span.alias("_span"))
    found = found.select("*", F.posexplode("rs").alias("_at", "partial")).withColumn("lag", F.col("_at") + 1)
    found = found.withColumn("n", F.size("y") - F.col("_span")).filter(fisher_z(F.col("partial"), F.col("n") - 3) > critical)
    found = found.withColumn("x", F.slice("x", F.col("_span") - F.col("lag") + 1, F.col("n"))).withColumn("y", F.slice("y", F.col("_span") + 1, F.col("n")))
    found = found.select(*columns, "partial", F.abs("partial").alias("strength"), F.lit(0).cast("long").alias("n_conditions"))
    target = ["incident_id", "dst"]
    n_parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy(*target).orderBy(F.desc("strength"), "src", "lag")
    level = 0
    while True:
        found = cut_lineage(found)
        if level == max_order:
            break
        level += 1
        largest = found.filter(F.col("n") - level - 3 > 0).groupBy(*target).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        if (largest or 0) <= level:
            break
        # a target's candidates meet in one task: ranked, and given the strongest, by one shuffle
        ranked = found.repartition(n_parts, *target).withColumn("_pos", F.row_number().over(order))
        strongest = F.collect_list(F.when(F.col("_pos") <= level + 1, F.struct("_pos", "x"))).over(Window.partitionBy(*target))
        others = F.slice(F.filter(F.array_sort(strongest), lambda t: t["_pos"] != F.col("_pos")), 1, level)
        ranked = ranked.withColumn("_given", others["x"]).withColumn("_tested", (F.size("_given") == level) & (F.col("n") - level - 3 > 0))
        tested = ranked.filter("_tested").withColumn("_r", partial_correlation(F.col("x"), F.col("y"), F.col("_given")))
        tested = tested.filter(fisher_z(F.col("_r"), F.col("n") - level - 3) > critical)
        tested = tested.select(*columns, F.col("_r").alias("partial"), F.least("strength", F.abs("_r")).alias("strength"), F.lit(level).cast("long").alias("n_conditions"))
        found = tested.unionByName(ranked.filter("not _tested").select(*found.columns))
    return found.filter("src <> dst").select("incident_id", "src", "dst", F.col("lag").cast("long").alias("lag"), "partial", "n_conditions")


def entry_weights(series: DataFrame, links: DataFrame, entries: DataFrame, partial: bool = True) -> DataFrame:
    """(incident_id, node, entry, w): abs (partial) correlation of every metric with its incident's entry metric.

    The covariates are the parents of the entry and of the node, without the two themselves: at most
    min(T // 3, 5) of them, those closest to the node by absolute correlation, then by name. They are picked per
    node before any vector is attached to them. An undefined value and the entry's own are 0.
    """
    z = series_vectors(series)[0].select("incident_id", F.col("metric").alias("node"), F.size("v").alias("n"), F.col("v").alias("z"))
    starts = entries.select("incident_id", "entry")
    front = z.join(starts.withColumnRenamed("entry", "node"), ["incident_id", "node"]).select("incident_id", F.col("node").alias("entry"), F.col("z").alias("x"))
    nodes = z.join(front, "incident_id")
    if partial:
        edges = links.select("incident_id", "src", "dst").distinct()
        of_node = edges.select("incident_id", F.col("dst").alias("node"), F.col("src").alias("cov"))
        of_entry = edges.join(starts.withColumnRenamed("entry", "dst"), ["incident_id", "dst"]).select("incident_id", F.col("src").alias("cov"))
        given = nodes.select("incident_id", "node").join(of_entry, "incident_id").union(of_node).distinct()
        given = given.join(nodes, ["incident_id", "node"]).filter((F.col("cov") != F.col("node")) & (F.col("cov") != F.col("entry")))
        given = given.join(z.select("incident_id", F.col("node").alias("cov"), F.col("z").alias("c")), ["incident_id", "cov"])
        close = F.coalesce(F.abs(partial_correlation(F.col("c"), F.col("z"))), F.lit(0.0))
        given = given.select("incident_id", "node", "cov", "n", "c", close.alias("close"))
        picked = top_k(given, ["incident_id", "node"], [F.desc("close"), "cov"], MAX_COVARIATES)
        picked = picked.filter(F.col("rank") <= F.greatest(F.lit(1), F.least(F.floor(F.col("n") / 3), F.lit(MAX_COVARIATES))))
        sets = picked.groupBy("incident_id", "node").agg(F.array_sort(F.collect_list(F.struct("rank", "c")))["c"].alias("given"))
        nodes = nodes.join(sets, ["incident_id", "node"], "left")
        none = F.array().cast("array<array<double>>")
        nodes = nodes.withColumn("w", partial_correlation(F.col("x"), F.col("z"), F.coalesce("given", none)))
    else:
        nodes = nodes.withColumn("w", partial_correlation(F.col("x"), F.col("z")))
    w = F.coalesce(F.least(F.abs("w"), F.lit(1.0)), F.lit(0.0))
    return nodes.select("incident_id", "node", "entry", F.when(F.col("node") == F.col("entry"), 0.0).otherwise(w).alias("w"))


def transition(
    series: DataFrame,
    links: DataFrame,
    entries: DataFrame,
    rho: float = BACKWARD,
    partial: bool = True,
) -> DataFrame:
    """Sparse row-normalised walk matrix (incident_id, src, dst, p).

    An effect steps to its cause with the cause's (partial) correlation to the entry metric, a
    cause back to its effect with ``rho`` times that, and a node stays with what exceeds its
    strongest cause. ``partial=False`` uses the plain correlation.
    """
    edges = cut_lineage(links.select("incident_id", "src", "dst").distinct())
    weights = cut_lineage(entry_weights(series, edges, entries, partial))
    of = lambda name: weights.select("incident_id", F.col("node").alias(name), "w")
    forward = edges.join(of("src"), ["incident_id", "src"]).select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = edges.select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    backward = edges.join(both, ["incident_id", "src", "dst"], "left_anti").join(of("dst"), ["incident_id", "dst"])
    backward = backward.select("incident_id", "src", "dst", (F.col("w") * rho).alias("w"))
    causes = forward.groupBy("incident_id", F.col("src").alias("node")).agg(F.max("w").alias("strongest"))
    rest = F.greatest(F.lit(0.0), F.col("w") - F.coalesce("strongest", F.lit(0.0)))
    stay = weights.join(causes, ["incident_id", "node"], "left").select("incident_id", F.col("node").alias("src"), F.col("node").alias("dst"), rest.alias("w"))
    arcs = forward.union(backward).union(stay).filter("w > 0")
    total = F.sum("w").over(Window.partitionBy("incident_id", "src"))
    return arcs.select("incident_id", "src", "dst", (F.col("w") / total).alias("p"))


def expected_visits(
    moves: DataFrame, entries: DataFrame, walks: int = WALKS, steps: int = WALK_STEPS
) -> DataFrame:
    """Expected visit counts of ``walks`` random walks of ``steps`` steps from each entry.

    The exact expectation replaces sampling: mass moves along the edges once per step, and a node
    without outgoing edges ends the walk. A graph of any size is spread over the cluster by node.
    """
    starts = entries.select("incident_id", F.col("entry").alias("node"), F.lit(float(walks)).alias("mass"))
    return messages.walk_visits(moves, starts, steps, ["incident_id"])


def gamma(visits: DataFrame, eta: DataFrame, share: float = 0.5) -> DataFrame:
    """share * visits / max + (1 - share) * eta / max per incident.

    Where the walk or all eta are missing, the other ranking stands alone as abs(eta).
    """
    whole = Window.partitionBy("incident_id")
    joined = eta.join(
        visits.withColumnRenamed("node", "metric"), ["incident_id", "metric"], "left"
    )
    walk = F.try_divide(F.coalesce("visits", F.lit(0.0)), F.max("visits").over(whole))
    level = F.try_divide(F.col("eta"), F.max("eta").over(whole))
    blended = F.lit(share) * walk + F.lit(1 - share) * level
    return joined.withColumn("gamma", F.coalesce(blended, F.abs("eta")))


def service_correlation(per_trace: DataFrame, entry: str) -> DataFrame:
    """Correlation of each service's self time with the entry service over all traces.

    per_trace is (incident_id, trace_id, service, self_time); a trace that misses a service counts
    as 0. Sums stand in for the dense table: only traces with both services add to the product. The rows are
    read once; a trace's rows, at most one per service, meet in one task.
    """
    trace = Window.partitionBy("incident_id", "trace_id")
    is_entry = F.col("service") == entry
    # x: the entry's value in the same trace; of every trace one row counts the trace itself
    rows = per_trace.withColumn("x", F.max(F.when(is_entry, F.col("self_time"))).over(trace))
    rows = rows.withColumn("_one", (F.row_number().over(trace.orderBy("service")) == 1).cast("long"))
    y, own = F.col("self_time"), F.when(is_entry, F.col("self_time"))
    sums = rows.groupBy("incident_id", "service").agg(
        F.sum("_one").alias("_n"),
        F.sum(own).alias("_sx"),
        F.sum(own**2).alias("_sxx"),
        F.sum(y).alias("sy"),
        F.sum(y**2).alias("syy"),
        F.coalesce(F.sum(y * F.col("x")), F.lit(0.0)).alias("sxy"),
    )
    # from here on one row per incident and service
    whole = Window.partitionBy("incident_id")
    other = (
        sums.select(
            "*",
            F.sum("_n").over(whole).alias("n"),
            F.max("_sx").over(whole).alias("sx"),
            F.max("_sxx").over(whole).alias("sxx"),
            F.max(is_entry).over(whole).alias("_entered"),
        )
        .filter(F.col("_entered") & ~is_entry)
    )
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = F.col("n") * F.col("sxx") - F.col("sx") ** 2
    vy = F.col("n") * F.col("syy") - F.col("sy") ** 2
    r = F.when(F.col("n") == 1, 1.0).when((vx > 1e-6) & (vy > 1e-6), num / F.sqrt(vx * vy)).otherwise(0.0)
    return other.select("incident_id", "service", r.alias("r"))


def service_walk(
    edges: DataFrame, corr: DataFrame, entry: str, rho: float = SERVICE_RHO, rounds: int = SERVICE_ROUNDS, tolerance: float = 1e-13
) -> DataFrame:
    """(incident_id, service, score): rounds of score = (weighted scores of the neighbours + own correlation) / 2.

    A caller listens to its callees with their correlation to the entry (-1 for the entry itself); a callee to its
    callers with ``rho`` times theirs, unless it calls them too or the caller is the entry; a service other than
    the entry to itself with what it exceeds its best callee by. A service's weights are divided by the sum of their
    absolute values, so that negative ones cannot cancel it and every round halves what is left to move; where that
    is 0 it listens to none. Calls to itself and to services without a correlation do not count.
    """
    front = corr.select("incident_id").distinct().select("incident_id", F.lit(entry).alias("service"), F.lit(-1.0).alias("r"))
    nodes = cut_lineage(corr.select("incident_id", "service", "r").union(front))
    of = lambda name, r: nodes.select("incident_id", F.col("service").alias(name), F.col("r").alias(r))
    calls = edges.select("incident_id", "src", "dst").filter("src <> dst").distinct()
    calls = cut_lineage(calls.join(of("src", "r_src"), ["incident_id", "src"]).join(of("dst", "r_dst"), ["incident_id", "dst"]))
    down = calls.select("incident_id", "src", "dst", F.col("r_dst").alias("w"))
    answered = calls.select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    up = calls.filter(F.col("src") != entry).join(answered, ["incident_id", "src", "dst"], "left_anti")
    up = up.select("incident_id", F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("r_src") * rho).alias("w"))
    best = calls.groupBy("incident_id", F.col("src").alias("service")).agg(F.max("r_dst").alias("best"))
    own = nodes.filter(F.col("service") != entry).join(best, ["incident_id", "service"], "left")
    more = F.greatest(F.lit(0.0), F.col("r") - F.coalesce("best", F.lit(0.0)))
    stay = own.select("incident_id", F.col("service").alias("src"), F.col("service").alias("dst"), more.alias("w"))
    arcs = down.union(up).union(stay)
    total = F.sum(F.abs("w")).over(Window.partitionBy("incident_id", "src"))
    arcs = arcs.withColumn("_total", total).filter("_total > 1e-9")
    arcs = arcs.select("incident_id", "src", "dst", (F.col("w") / F.col("_total")).alias("weight"))
    base = nodes.select("incident_id", F.col("service").alias("node"), F.when(F.col("service") == entry, 0.0).otherwise(F.col("r")).alias("value"))
    scores = messages.damped_scores(arcs, base, rounds, ["incident_id"], 0.5, tolerance)
    return scores.select("incident_id", F.col("node").alias("service"), "score")


def propagation_paths(links: DataFrame, sources: DataFrame, max_edges: int = 3, limit: int = 5) -> DataFrame:
    """Breadth-first paths from ranked sources: each node once per source, ``limit`` per incident.

    sources is (incident_id, source_rank, metric). A node reached twice keeps its first path.
    """
    edges = links.select("incident_id", F.col("src").alias("node"), "dst").distinct()
    keys = ["incident_id", "source_rank"]
    level = sources.select(*keys, F.col("metric").alias("node"), F.col("metric").alias("path"))
    seen = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_edges + 1):
        step = (
            level.join(edges, ["incident_id", "node"])
            .select(*keys, F.col("dst").alias("node"), F.concat_ws(" → ", "path", "dst").alias("path"))
            .groupBy(*keys, "node")
            .agg(F.min("path").alias("path"))
            .join(seen.select(*keys, "node"), [*keys, "node"], "left_anti")
        )
        level = step
        seen = seen.unionByName(step.withColumn("depth", F.lit(depth)))
    found = seen.filter("depth > 0").drop("node")
    return top_k(found, ["incident_id"], ["source_rank", "depth", "path"], limit, "pos")


def graph_size(links: DataFrame) -> DataFrame:
    """Nodes, distinct edges and edges per node of each incident's graph."""
    edges = links.select("incident_id", "src", "dst").distinct()
    nodes = edges.select("incident_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return (
        edges.groupBy("incident_id")
        .agg(F.count("*").alias("n_edges"))
        .join(nodes.groupBy("incident_id").agg(F.count("*").alias("n_nodes")), "incident_id")
        .withColumn("density", F.col("n_edges") / F.greatest("n_nodes", F.lit(1)))
    )
