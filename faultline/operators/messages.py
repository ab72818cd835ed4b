"""Rounds of message passing over an edge table: join, sum by target, repeat."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut_lineage

#: rounds planned in one job before the state is written to the shared folder
CUT_EVERY = 5


def dealt(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """arcs written once and kept dealt out by ``keys``, so that no round moves them again."""
    n = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(arcs).repartition(n, *keys).persist()


def iterate(
    state: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    rounds: int,
    keys: Sequence[str] = (),
    value: str | None = None,
    tolerance: float = 0.0,
    cut_every: int = CUT_EVERY,
) -> DataFrame:
    """Apply ``step`` ``rounds`` times; the state is checkpointed every few rounds, so plans stay short and a lost
    executor costs a few rounds at most.

    With ``value`` the loop also ends when no key's value moved by more than ``tolerance`` over the last rounds
    between two checkpoints.
    """
    done = 0
    while done < rounds:
        before = state
        for _ in range(min(cut_every, rounds - done)):
            state = step(state)
            done += 1
        state = cut_lineage(state)
        if value is not None and done < rounds:
            old = before.select(*keys, F.col(value).alias("_old"))
            moved = state.join(old, list(keys), "left").agg(F.max(F.abs(F.col(value) - F.coalesce("_old", F.lit(0.0)))))
            if (moved.first()[0] or 0.0) <= tolerance:
                break
    return state


def walk_visits(moves: DataFrame, starts: DataFrame, steps: int, keys: Sequence[str]) -> DataFrame:
    """(keys, node, visits): total mass that arrives at each node within ``steps`` steps.

    moves is (keys, src, dst, p), starts (keys, node, mass). Mass at a node moves along its arcs once per step; at a
    node without arcs it stays out. Each node also has an arc to itself that carries only what it has counted, so
    one join and one sum make a round, combined in the tasks before the shuffle.
    """
    keys = list(keys)
    ends = moves.select(*keys, F.explode(F.array("src", "dst")).alias("node"))
    nodes = ends.union(starts.select(*keys, "node")).distinct()
    arcs = moves.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_to"), F.col("p").alias("_p"), F.lit(0.0).alias("_kept"))
    stay = nodes.select(*keys, "node", F.col("node").alias("_to"), F.lit(0.0).alias("_p"), F.lit(1.0).alias("_kept"))
    arcs = dealt(arcs.union(stay), [*keys, "node"])
    state = starts.select(*keys, "node", F.col("mass").cast("double").alias("mass"), F.lit(0.0).alias("visits"))

    def step(state: DataFrame) -> DataFrame:
        sent = state.join(arcs, [*keys, "node"])
        flow = F.col("mass") * F.col("_p")
        sums = sent.groupBy(*keys, F.col("_to").alias("node")).agg(
            F.sum(flow).alias("mass"), F.sum(flow + F.col("visits") * F.col("_kept")).alias("visits")
        )
        return sums

    out = iterate(state, step, steps).filter("visits > 0").select(*keys, "node", "visits")
    arcs.unpersist()
    return out


def damped_scores(
    arcs: DataFrame, base: DataFrame, rounds: int, keys: Sequence[str], damping: float = 0.5, tolerance: float = 0.0
) -> DataFrame:
    """(keys, node, score) after rounds of score = damping * sum(weight * score of dst) + (1 - damping) * base.

    arcs is (keys, src, dst, weight), base (keys, node, value) with every node once. All scores start from 0.
    """
    keys = list(keys)
    back = arcs.select(*keys, F.col("dst").alias("node"), F.col("src").alias("_to"), (F.col("weight") * damping).alias("_w"))
    back = dealt(back, [*keys, "node"])
    pull = cut_lineage(base.select(*keys, "node", (F.col("value") * (1 - damping)).alias("_part")))

    def step(state: DataFrame) -> DataFrame:
        sent = state.join(back, [*keys, "node"]).select(*keys, F.col("_to").alias("node"), (F.col("_w") * F.col("score")).alias("_part"))
        return sent.union(pull).groupBy(*keys, "node").agg(F.sum("_part").alias("score"))

    state = pull.select(*keys, "node", F.lit(0.0).alias("score"))
    out = iterate(state, step, rounds, [*keys, "node"], "score", tolerance)
    back.unpersist()
    return out
