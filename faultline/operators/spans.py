"""Trace operators over flat spans.

Expected columns: trace_id, span_id, parent_span_id (null at a root), service, duration, status, ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.scale import global_index, lookup_join, spread, top_k
from faultline.session import cut_lineage

TRACE = "trace_id"

# fixed values: path prefixes and separator
PATH_START = "start"
PATH_UNCLEAR = "unclear_start"
PATH_CYCLIC = "cyclic"
PATH_SEP = "#"

#: traces of up to this many spans are worked on as one row, longer ones span by span
ROW_SPANS = 64


def with_self_time(spans: DataFrame, keys=(TRACE,), clip: bool = True) -> DataFrame:
    """Add n_children and self_time = duration - longest child, clipped at 0 on request.

    Every span is sent to its own id and, as a child, to its parent's id, and both meet in one
    aggregation: the spans are read once and never joined to themselves. The key holds the span id
    and children are combined before the shuffle, so neither a huge trace nor a huge parent ends up
    in one task.
    """
    kept = [c for c in spans.columns if c not in (*keys, "span_id")]
    own = F.struct(
        F.col("span_id").alias("id"), F.struct(*kept).alias("own"), F.lit(None).cast("double").alias("child")
    )
    own_type = spans.select(F.struct(*kept).alias("own")).schema["own"].dataType
    as_child = F.struct(
        F.col("parent_span_id").alias("id"), F.lit(None).cast(own_type).alias("own"), F.col("duration").alias("child")
    )
    sent = F.when(F.col("parent_span_id").isNull(), F.array(own)).otherwise(F.array(own, as_child))
    met = (
        spans.select(*keys, F.inline(sent))
        .groupBy(*keys, F.col("id").alias("span_id"))
        .agg(
            F.max("own").alias("own"),
            F.count("child").alias("n_children"),
            F.max("child").alias("max_child"),
        )
        .filter(F.col("own").isNotNull())
    )
    self_time = F.col("own.duration") - F.coalesce(F.col("max_child"), F.lit(0.0))
    if clip:
        self_time = F.greatest(F.lit(0.0), self_time)
    return met.select(*keys, "span_id", "own.*", "n_children", self_time.alias("self_time"))


def with_parent(spans: DataFrame) -> DataFrame:
    """Add parent_service and link: root, child, or orphan where the parent is missing."""
    parents = spans.select(
        TRACE, F.col("span_id").alias("parent_span_id"), F.col("service").alias("parent_service")
    )
    link = (
        F.when(F.col("parent_span_id").isNull(), "root")
        .when(F.col("parent_service").isNull(), "orphan")
        .otherwise("child")
    )
    return spans.join(parents, [TRACE, "parent_span_id"], "left").withColumn("link", link)


def trace_summary(spans: DataFrame, fallback_root: bool = True) -> DataFrame:
    """One row per trace: root span, span count, start and end.

    The root is the last span without a parent, else the first span; without the fallback a trace
    lacking a parentless span keeps a null root.
    """
    at = F.struct("ts", "span_id")
    roots = F.max(F.when(F.col("parent_span_id").isNull(), at))["span_id"]
    if fallback_root:
        roots = F.coalesce(roots, F.min(at)["span_id"])
    return spans.groupBy(TRACE).agg(
        roots.alias("root_span_id"),
        F.count("*").alias("span_count"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.max("status").alias("status"),
    )


def _by_length(spans: DataFrame, row_spans: int) -> tuple[DataFrame, DataFrame | None]:
    """Spans of the traces that can be one row, dealt out by trace, and the spans of all others (None if there are none).

    The others have more than ``row_spans`` spans, or a span id that is missing or met twice.
    """
    ids = spans.filter(F.col(TRACE).isNotNull()).groupBy(TRACE, "span_id").agg(F.count("*").alias("n"))
    unclear = (F.max("n") > 1) | (F.count("span_id") < F.count("*"))
    sizes = ids.groupBy(TRACE).agg(F.sum("n").alias("size"), unclear.alias("unclear"))
    odd = F.col("unclear") | (F.col("size") > row_spans)
    total, n_odd = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(odd)).first()
    spans = spans.filter(F.col(TRACE).isNotNull())
    if n_odd == 0:
        return spread(spans, total, [TRACE]), None
    names = cut_lineage(sizes.filter(odd).select(TRACE))
    regular = lookup_join(spans, names, [TRACE], "left_anti")
    return spread(regular, total, [TRACE]), lookup_join(spans, names, [TRACE], "left_semi")


def _trace_rows(regular: DataFrame, timed: bool = False) -> DataFrame:
    """One row per trace: ``spans``, an array of its spans with call_path and depth, and with self time (not clipped)
    and n_children if ``timed``. Every span's chain of parents is looked up in its own row."""
    kept = [c for c in regular.columns if c not in (TRACE, "call_path", "depth")]
    link = lambda x: F.struct(x["parent_span_id"].alias("parent"), F.coalesce(x["service"], F.lit("")).alias("service"))
    rows = regular.groupBy(TRACE).agg(F.collect_list(F.struct(*kept)).alias("_s"))
    rows = rows.withColumn("_up", F.map_from_entries(F.transform("_s", lambda x: F.struct(x["span_id"], link(x)))))

    def chain(x):
        def step(so_far, _):
            above = F.col("_up")[F.element_at(so_far, -1)["parent"]]
            return F.when(above.isNull(), so_far).otherwise(F.concat(so_far, F.array(above)))

        return F.aggregate(F.sequence(F.lit(1), F.size("_s")), F.array(link(x)), step)

    def finished(y):
        x, c = y["x"], y["c"]
        cyclic = F.size(c) > F.size("_s")
        prefix = F.when(cyclic, PATH_CYCLIC).when(F.element_at(c, -1)["parent"].isNull(), PATH_START).otherwise(PATH_UNCLEAR)
        names = F.when(cyclic, F.array(F.coalesce(x["service"], F.lit("")))).otherwise(F.reverse(c["service"]))
        fields = [x[k].alias(k) for k in kept]
        fields += [F.concat_ws(PATH_SEP, prefix, names).alias("call_path"), F.when(~cyclic, F.size(c).cast("long")).alias("depth")]
        if timed:
            fields += [
                F.size(F.filter(y["d"], lambda d: d.isNotNull())).cast("long").alias("n_children"),
                (x["duration"] - F.coalesce(F.array_max(y["d"]), F.lit(0.0))).alias("self_time"),
            ]
        return F.struct(*fields)

    def looked_up(x):
        parts = [x.alias("x"), chain(x).alias("c")]
        if timed:
            children = F.filter("_s", lambda z: z["parent_span_id"] == x["span_id"])
            parts.append(children["duration"].alias("d"))
        return F.struct(*parts)

    return rows.select(TRACE, F.transform(F.transform("_s", looked_up), finished).alias("spans"))


def call_paths(spans: DataFrame, row_spans: int = ROW_SPANS) -> DataFrame:
    """Add call_path (root to span, joined by '#') and depth.

    A trace of up to ``row_spans`` spans is put into one row, by one shuffle, and its chains are followed there.
    Longer traces, and those with unclear ids, go span by span in rounds. A chain with more links than its trace has
    spans runs in a cycle: its spans and all that hang under them get the prefix 'cyclic', their own service and no depth.
    """
    regular, others = _by_length(spans, row_spans)
    kept = [c for c in spans.columns if c not in (TRACE, "span_id", "call_path", "depth")]
    found = _trace_rows(regular).select(TRACE, F.inline("spans"))
    found = found.select(TRACE, "span_id", *kept, "call_path", "depth")
    return found if others is None else found.unionByName(_paths_in_rounds(others))


def timed_paths(spans: DataFrame, row_spans: int = ROW_SPANS) -> DataFrame:
    """Call paths and self time (not clipped) together, with one shuffle for traces that are one row."""
    regular, others = _by_length(spans, row_spans)
    found = _trace_rows(regular, timed=True).select(TRACE, F.inline("spans"))
    return found if others is None else found.unionByName(with_self_time(_paths_in_rounds(others), clip=False))


def marked_vectors(spans: DataFrame, row_spans: int = ROW_SPANS) -> DataFrame:
    """``stv`` of all traces with ``failed`` (highest status) and the trace's signature, kept in files."""
    regular, others = _by_length(spans, row_spans)

    def longest(p):
        here = F.filter("spans", lambda z: z["call_path"] == p)
        return F.struct(p.alias("call_path"), F.array_max(here["duration"]).cast("long").alias("rt"))

    paths = F.array_distinct(F.col("spans")["call_path"])
    rows = _trace_rows(regular).select(TRACE, F.array_max(F.col("spans")["status"]).alias("failed"), F.transform(paths, longest).alias("v"))
    # a path is one element of v, so the exclusive or of hashes stands for the set, as in ``signatures``
    live = F.filter("v", lambda x: x["rt"] != 0)["call_path"]
    mixed = lambda *more: F.aggregate("live", F.lit(0).cast("long"), lambda h, p: h.bitwiseXOR(F.xxhash64(*more, p)))
    rows = rows.withColumn("live", live).select(
        TRACE, "failed", F.size("live").cast("long").alias("n_paths"), mixed().alias("h1"), mixed(F.lit("second")).alias("h2"), "v"
    )
    found = cut_lineage(rows).select(TRACE, F.inline("v"), "failed", *SIGNATURE)
    if others is None:
        return found
    walked = cut_lineage(_paths_in_rounds(others))
    failed = walked.groupBy(TRACE).agg(F.max("status").alias("failed"))
    vectors = stv(walked)
    vectors = vectors.join(failed, TRACE).join(signatures(vectors), TRACE, "left")
    return found.unionByName(cut_lineage(vectors.select(*found.columns)))


def _paths_in_rounds(spans: DataFrame) -> DataFrame:
    """Call paths of traces of any length.

    Ancestor links are doubled every round, so a chain of n spans needs about log2(n) joins. Only ids and paths go
    through the rounds, and spans that reached their top leave them; each round is checkpointed, and the other
    columns are joined once at the end. A span with very many children is one row of the looked-up side; the skewed
    side is split by the adaptive join.
    """
    ids = spans.select(TRACE, "span_id", "parent_span_id", "service").distinct()
    sizes = ids.groupBy(TRACE).agg(F.count("*").alias("size"))
    state = ids.join(sizes, TRACE).select(
        TRACE,
        "span_id",
        "parent_span_id",
        "service",
        "size",
        F.col("parent_span_id").alias("up"),
        F.coalesce("service", F.lit("")).alias("path"),
        F.lit(1).cast("long").alias("depth"),
        F.lit(PATH_START).alias("prefix"),
    )
    state = cut_lineage(state)
    done, pending = [state.filter(F.col("up").isNull())], state.filter(F.col("up").isNotNull())
    while not pending.isEmpty():
        above = pending
        for part in done:
            above = above.unionByName(part)
        above = above.select(
            TRACE,
            F.col("span_id").alias("up"),
            F.col("up").alias("a_up"),
            F.col("path").alias("a_path"),
            F.col("depth").alias("a_depth"),
            F.col("prefix").alias("a_prefix"),
        )
        depth = F.col("depth") + F.coalesce("a_depth", F.lit(0))
        cyclic = (F.col("a_prefix") == PATH_CYCLIC) | (F.col("a_up").isNotNull() & (depth > F.col("size")))
        stepped = pending.join(above, [TRACE, "up"], "left").withColumn("_cyclic", F.coalesce(cyclic, F.lit(False)))
        stepped = stepped.select(
            TRACE,
            "span_id",
            "parent_span_id",
            "service",
            "size",
            F.when(~F.col("_cyclic"), F.col("a_up")).alias("up"),
            F.when(F.col("_cyclic"), F.coalesce("service", F.lit(""))).otherwise(F.concat_ws(PATH_SEP, "a_path", "path")).alias("path"),
            F.when(~F.col("_cyclic"), depth).alias("depth"),
            F.when(F.col("_cyclic"), PATH_CYCLIC).otherwise(F.coalesce("a_prefix", F.lit(PATH_UNCLEAR))).alias("prefix"),
        )
        stepped = cut_lineage(stepped)
        done.append(stepped.filter(F.col("up").isNull()))
        pending = stepped.filter(F.col("up").isNotNull())
    state = done[0]
    for part in done[1:]:
        state = state.unionByName(part)
    found = state.select(
        TRACE, "span_id", F.col("parent_span_id").alias("_parent"), F.col("service").alias("_service"),
        F.concat_ws(PATH_SEP, "prefix", "path").alias("call_path"), "depth",
    )
    same = F.col("_parent").eqNullSafe(F.col("parent_span_id")) & F.col("_service").eqNullSafe(F.col("service"))
    kept = [c for c in spans.columns if c not in (TRACE, "span_id", "call_path", "depth")]
    joined = spans.drop("call_path", "depth").join(found, [TRACE, "span_id"]).filter(same)
    return joined.select(TRACE, "span_id", *kept, "call_path", "depth")


def stv(paths: DataFrame, keys=(TRACE,)) -> DataFrame:
    """Service-call vector as rows: longest whole-millisecond response per trace and call path."""
    rt = F.max(F.col("duration").cast("long"))
    return paths.groupBy(*keys, "call_path").agg(rt.alias("rt"))


def call_path_dictionary(paths: DataFrame) -> DataFrame:
    """Distinct call paths, sorted and numbered from 0."""
    return global_index(paths.select("call_path").distinct(), ["call_path"], "path_id")


def known_paths(vectors: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add path_id from the dictionary (null where the path is unknown)."""
    return lookup_join(vectors, dictionary, ["call_path"], "left")


def valid_traces(vectors_with_ids: DataFrame) -> DataFrame:
    """Per trace whether all its call paths are known; one unknown path makes the trace invalid."""
    return vectors_with_ids.groupBy(TRACE).agg(
        (F.sum(F.col("path_id").isNull().cast("int")) == 0).alias("valid"),
        F.count("*").alias("n_paths"),
    )


def signatures(vectors: DataFrame) -> DataFrame:
    """Per trace a hash of its set of non-zero call paths.

    The exclusive or of two independent hashes and the number of paths stand for the set, so the whole
    path list of a large trace never has to sit in one buffer.
    """
    live = vectors.filter(F.col("rt") != 0)
    if set(SIGNATURE) <= set(vectors.columns):
        return live.select(TRACE, *SIGNATURE).distinct()
    return live.groupBy(TRACE).agg(
        F.count("*").alias("n_paths"),
        F.bit_xor(F.xxhash64("call_path")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "call_path")).alias("h2"),
    )


SIGNATURE = ("n_paths", "h1", "h2")


def signed(vectors: DataFrame) -> DataFrame:
    """The non-zero positions with their trace's signature, which ``marked_vectors`` brings along."""
    live = vectors.filter(F.col("rt") != 0)
    return live if set(SIGNATURE) <= set(vectors.columns) else live.join(signatures(vectors), TRACE)


def matched_normals(normal_vectors: DataFrame, limit: int = 6) -> DataFrame:
    """The first ``limit`` normal traces of every signature, by trace id."""
    return top_k(signatures(normal_vectors), SIGNATURE, [TRACE], limit, "pos")


def signature_matches(abnormal_vectors: DataFrame, normal_vectors: DataFrame, limit: int = 6) -> DataFrame:
    """Abnormal traces with the first normal traces of their signature, numbered by ``pos``.

    There can be as many signatures as traces: none are sent to the driver or copied, both sides are shuffled once and a
    hot signature is split by the adaptive join.
    """
    firsts = matched_normals(normal_vectors, limit).withColumnRenamed(TRACE, "normal_trace_id")
    return signatures(abnormal_vectors).join(firsts, list(SIGNATURE))


def normal_profile(normal_vectors: DataFrame, limit: int | None = 6) -> DataFrame:
    """Mean and sample deviation per signature and call path over its first normal traces, or over all if ``limit`` is None.

    Of the first ones, Spark prunes the traces of every signature before the shuffle, and what is left of a signature
    meets in one task; without a limit, sums are combined before the shuffle.
    """
    rows = signed(normal_vectors)
    if limit is not None:
        firsts = F.dense_rank().over(Window.partitionBy(*SIGNATURE).orderBy(TRACE))
        rows = rows.withColumn("_pos", firsts).filter(F.col("_pos") <= limit)
    return rows.groupBy(*SIGNATURE, "call_path").agg(
        F.count("*").alias("n_match"),
        F.avg("rt").alias("mean"),
        F.when(F.count("*") > 1, F.stddev_samp("rt")).alias("std"),
    )


def timeout_positions(
    abnormal_vectors: DataFrame, normal_vectors: DataFrame, limit: int | None = 6
) -> DataFrame:
    """Every non-zero position of abnormal traces with its normal range and excess.

    ``out`` marks values outside mean +- 3 std; a position with std 0 or one match never alarms. There can be as many
    profiles as traces, so both sides are shuffled once and a hot signature is split by the adaptive join.
    """
    joined = signed(abnormal_vectors).join(normal_profile(normal_vectors, limit), [*SIGNATURE, "call_path"], "left")
    high, low = F.col("mean") + 3 * F.col("std"), F.col("mean") - 3 * F.col("std")
    out = (F.col("std") > 0) & ((F.col("rt") > high) | (F.col("rt") < low))
    return joined.withColumn("out", F.coalesce(out, F.lit(False))).withColumn(
        "score", F.when(F.col("out"), F.try_divide(F.col("rt") - F.col("mean"), F.col("std")) / 3)
    )


def trace_verdicts(positions: DataFrame, min_score: float = 2.0, *more) -> DataFrame:
    """Per abnormal trace: structural (no normal with its signature), timeout, or none; ``more`` aggregates beside it."""
    score = F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0))
    kind = (
        F.when(F.col("n_match") == 0, "structural")
        .when((F.col("n_out") > 0) & (F.col("score") > min_score), "timeout")
        .otherwise("none")
    )
    return (
        positions.groupBy(TRACE)
        .agg(
            F.coalesce(F.max("n_match"), F.lit(0)).cast("long").alias("n_match"),
            F.sum(F.col("out").cast("int")).cast("long").alias("n_out"),
            score.alias("score"),
            *more,
        )
        .withColumn("verdict", kind)
    )


def service_self_time(spans_with_self_time: DataFrame, keys=()) -> DataFrame:
    """Per service: mean and population deviation of self time."""
    return spans_with_self_time.groupBy(*keys, "service").agg(
        F.count("*").alias("n"),
        F.avg("self_time").alias("mean_self"),
        F.stddev_pop("self_time").alias("std_self"),
    )


def service_edges(spans: DataFrame, keys=()) -> DataFrame:
    """Distinct caller and callee pairs."""
    linked = with_parent(spans).filter(F.col("link") == "child")
    return linked.select(
        *keys, F.col("parent_service").alias("src"), F.col("service").alias("dst")
    ).distinct()


def spectrum(traces: DataFrame, visited: DataFrame) -> DataFrame:
    """Ochiai score per service from failed and passed traces.

    ``traces`` has trace_id and failed; ``visited`` the distinct (trace_id, service) pairs. The
    number of failed traces a service missed follows from one total, not from services x traces.
    """
    total_failed = traces.select(F.coalesce(F.sum("failed"), F.lit(0)).alias("n")).scalar()
    floor = lambda c: F.when(c > 0, c.cast("double")).otherwise(F.lit(0.0001))
    counts = (
        visited.join(traces.select(TRACE, "failed"), TRACE)
        .groupBy("service")
        .agg(F.sum("failed").alias("ef0"), F.sum(1 - F.col("failed")).alias("ep0"))
    )
    ef, ep, nf = floor(F.col("ef0")), floor(F.col("ep0")), floor(F.col("_total") - F.col("ef0"))
    return counts.withColumn("_total", total_failed).select(
        "service", "ef0", "ep0", (ef / F.sqrt((ef + ep) * (ef + nf))).alias("ochiai")
    )


def trace_vectors(spans_with_depth: DataFrame, services: list[str]) -> DataFrame:
    """Classifier features of a trace: service counts, then three values per known service.

    In breadth-first order the last visited span of a service wins.
    """
    last = F.max_by(
        F.struct("duration", "status", "self_time"), F.struct("depth", "ts", "span_id")
    )
    per = spans_with_depth.groupBy(TRACE, "service").agg(last.alias("v"))
    wide = per.groupBy(TRACE).agg(
        F.count("*").alias("visited"),
        *[
            F.max(F.when(F.col("service") == s, F.col(f"v.{f}"))).alias(f"{s}_{f}")
            for s in services
            for f in ("duration", "status", "self_time")
        ],
    )
    return wide.select(
        TRACE,
        F.lit(len(services)).cast("long").alias("n_services"),
        "visited",
        *[
            F.coalesce(F.col(f"{s}_{f}"), F.lit(0)).cast("double").alias(f"{s}_{f}")
            for s in services
            for f in ("duration", "status", "self_time")
        ],
    )
