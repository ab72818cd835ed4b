"""Operators on many small graphs at once, keyed by incident."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ranking import rank_within
from faultline.operators.scale import global_index

DROP_SHARE = 0.2  # fixed value


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes of the graph."""
    ends = nodes.select("incident_id", "node")
    for end in ("src", "dst"):
        edges = edges.join(ends.withColumnRenamed("node", end), ["incident_id", end], "left_semi")
    return edges.select("incident_id", "src", "dst")


def add_self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Add a loop for every node nobody points to."""
    lonely = nodes.select("incident_id", "node").join(
        edges.select("incident_id", F.col("dst").alias("node")), ["incident_id", "node"], "left_anti"
    )
    loops = lonely.select("incident_id", F.col("node").alias("src"), F.col("node").alias("dst"))
    return edges.unionByName(loops)


def neighbour_mean(nodes: DataFrame, edges: DataFrame, features: list[str]) -> DataFrame:
    """Own features next to the mean over in-neighbours (their number floored at 1)."""
    sums = (
        edges.join(nodes.withColumnRenamed("node", "src"), ["incident_id", "src"])
        .groupBy("incident_id", F.col("dst").alias("node"))
        .agg(F.count("*").alias("_deg"), *[F.sum(f).alias(f"_{f}") for f in features])
    )
    degree = F.greatest(F.coalesce("_deg", F.lit(0)), F.lit(1))
    return nodes.join(sums, ["incident_id", "node"], "left").select(
        *nodes.columns, *[(F.coalesce(F.col(f"_{f}"), F.lit(0.0)) / degree).alias(f"n{f}") for f in features]
    )


def drop_nodes(
    nodes: DataFrame, edges: DataFrame, roots: DataFrame, share: float = DROP_SHARE, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Drop a share of the non-root nodes by seeded hash, keep edges between the rest, renumber."""
    marked = nodes.join(roots, "incident_id", "left").withColumn(
        "_free", ~F.col("node").eqNullSafe(F.col("root"))
    )
    order = ["_free", F.xxhash64(F.lit(seed), "incident_id", "node"), "node"]
    ranked = rank_within(marked, ["incident_id"], order, "_rn")
    sizes = marked.groupBy("incident_id").agg(
        F.count("*").alias("_n"), F.count_if("_free").alias("_nf")
    )
    keep = F.col("_n") - F.floor(F.col("_nf") * share)
    kept = ranked.join(sizes, "incident_id").filter(F.col("_rn") <= keep)
    kept = rank_within(kept, ["incident_id"], ["node"], "node_id").withColumn(
        "node_id", F.col("node_id") - 1
    )
    kept = kept.select(*nodes.columns, "node_id")
    return kept, inside(edges, kept)


def batch_ids(nodes: DataFrame) -> DataFrame:
    """Running node ids over all graphs: each graph starts where the one before ended."""
    return global_index(nodes, ["incident_id", "node"], "node_id")
