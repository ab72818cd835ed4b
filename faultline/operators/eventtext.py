"""Event strings per graph node, their embeddings and vocabulary coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.scale import lookup_join

# fixed values
LOG_BUCKETS = 10_000
LOG_HEAD = 200
MAX_SCALE = 3.0
NO_ADDRESS = "0.0.0.0"
GATES = {"metric": 0.6, "trace": 0.6, "log": 0.4}


def metric_event(service: Column, metric: Column, direction: Column) -> Column:
    return F.concat_ws("&", service, F.lit(NO_ADDRESS), metric, direction)


def trace_event(src: Column, dst: Column, operation: Column, error: Column) -> Column:
    return F.concat_ws("&", src, dst, operation, error)


def log_event(service: Column, message: Column) -> Column:
    """service & bucket of the message's head; md5 keeps the bucket stable between runs."""
    head = F.substring(message, 1, LOG_HEAD)
    bucket = F.conv(F.substring(F.md5(head), 1, 8), 16, 10).cast("long") % LOG_BUCKETS
    return F.concat_ws("&", service, bucket)


def to_both_ends(events: DataFrame, nodes: list[str]) -> DataFrame:
    """A trace event goes to every node whose name is part of its source or destination."""
    names = F.array(*map(F.lit, nodes))
    owners = F.filter(names, lambda n: F.contains(F.col("src"), n) | F.contains(F.col("dst"), n))
    return events.withColumn("node", F.explode(owners))


def first_owner(name: Column, nodes: list[str]) -> Column:
    """The first node, in list order, whose name is part of the file name."""
    return F.get(F.filter(F.array(*map(F.lit, nodes)), lambda n: F.contains(name, n)), F.lit(0))


def intensity(vector: Column, n_events: Column) -> Column:
    """Vector times min(log1p(count), 3)."""
    scale = F.least(F.log1p(n_events.cast("double")), F.lit(MAX_SCALE))
    return F.transform(vector, lambda x: x * scale)


def mean_vectors(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Element-wise mean per key, aggregated by position so that no group is held whole."""
    cells = vectors.select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "m")))["m"].alias("vector"), F.max("n").alias("n")
    )


def hash_vectors(events: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Mean of per-event pseudo-random normal vectors seeded by the event text (Box-Muller)."""
    unit = lambda salt, i: (
        F.pmod(F.xxhash64(F.lit(salt), F.col("event"), F.lit(i)), F.lit(1_000_003)).cast("double") + 0.5
    ) / 1_000_003.0
    cells = [
        F.sqrt(-2 * F.log(unit("a", i))) * F.cos(2 * F.pi() * unit("b", i)) for i in range(dim)
    ]
    counts = events.groupBy(*keys, "event").agg(F.count("*").alias("c"))
    total = F.sum("c")
    return counts.groupBy(*keys).agg(
        F.array(*[F.sum(cell * F.col("c")) / total for cell in cells]).alias("vector")
    )


def embedding_lookup(node_events: DataFrame, cache: DataFrame) -> DataFrame:
    """Vector per (modality, node) that has events, scaled by their number."""
    joined = lookup_join(node_events, cache.drop("n"), ["modality", "node"], "inner")
    return joined.withColumn("vector", intensity(F.col("vector"), F.col("n_events")))


def vocabulary_coverage(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of distinct event tokens known to the encoder, per modality, and the gate verdict."""
    words = events.select("modality", F.explode(F.split("event", "&")).alias("word")).distinct()
    known = vocabulary.select("modality", "word").distinct().withColumn("hit", F.lit(1.0))
    cover = words.join(known, ["modality", "word"], "left").groupBy("modality").agg(
        F.count("*").alias("n_words"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage")
    )
    gate = F.element_at(F.create_map(*[F.lit(x) for kv in GATES.items() for x in kv]), F.col("modality"))
    return cover.withColumn("passes", F.col("coverage") >= gate)


def training_rows(labels: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (index, node, three vectors, is_root, type_no, split) for graphs with a known root.

    Failure types are numbered by name, with ``normal`` as 0.
    """
    kinds = labels.select("anomaly_type").distinct()
    others = F.array_sort(F.array_remove(F.collect_set("anomaly_type"), "normal"))
    ordered = kinds.agg(others.alias("o")).scalar()
    type_no = F.when(F.col("anomaly_type") == "normal", 0).otherwise(F.array_position(ordered, F.col("anomaly_type")))
    known = labels.join(
        nodes.select("index", F.col("node").alias("instance")), ["index", "instance"], "left_semi"
    )
    wide = vectors.groupBy("index", "node").agg(
        *[F.first(F.when(F.col("modality") == m, F.col("vector")), True).alias(m) for m in ("metric", "trace", "log")]
    )
    rows = nodes.join(known, "index").join(wide, ["index", "node"])
    return rows.filter(
        F.col("metric").isNotNull() & F.col("trace").isNotNull() & F.col("log").isNotNull()
    ).select(
        "index", "node", "metric", "trace", "log",
        (F.col("node") == F.col("instance")).cast("int").alias("is_root"),
        type_no.cast("long").alias("type_no"),
        F.col("data_type").alias("split"),
    )
