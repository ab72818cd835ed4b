"""Connected components of an edge table by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut_lineage

#: edges to a task: a round over a small table makes few files, whatever the number of shuffle partitions
TASK_EDGES = 100_000


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is the smallest node reachable.

    Distributed union-find by alternating two steps until nothing changes: first every node hands the
    smallest node it knows to its larger neighbours, then to its smaller ones. Minima are combined before
    the shuffle and the joins carry one row per edge, so a node with very many edges is split like any
    skewed join. Every round ends in a checkpoint in the shared folder. Edges with a null end are left
    out; an empty table gives an empty result.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u > v").distinct()
    pairs = cut_lineage(pairs)
    parts = -(-pairs.count() // TASK_EDGES) or 1
    pairs = pairs.coalesce(parts)
    while True:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m")).coalesce(parts)
        # larger neighbours of u learn the smallest node of u
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u > v").coalesce(parts).distinct().coalesce(parts))
        # u and its smaller neighbours hang under the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        small = small.coalesce(parts).union(least).distinct().coalesce(parts)
        small = cut_lineage(small)
        same = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        if same.first() == pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first():
            break
        pairs = small
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
