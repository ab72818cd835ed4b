"""Building blocks that keep joins, top-k, numbering and quantiles safe under skew.

Every helper is exact: hot keys are split or pre-aggregated, never dropped or sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut_lineage

MAX_BROADCAST_ROWS = 200_000
SALTS = 32
TASK_ROWS = 500_000
#: Spark prunes row_number() <= k before the shuffle only for k up to this setting's default
WINDOW_LIMIT = 1000


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether df holds at most max_rows rows; the check itself reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def salted(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """Give every row a stable salt taken from its own content."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """One copy of every row per salt."""
    return df.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def spread(df: DataFrame, n_rows: int, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Partition by ``keys`` so that a task gets about ``task_rows`` of the ``n_rows`` rows, at any size."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-n_rows // task_rows)), *keys)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a smaller one on keys that may be hot in the large table.

    The small side is broadcast after its size was checked. Beyond the bound both sides shuffle,
    with each hot key of ``facts`` spread over ``salts`` tasks.
    """
    dim = dim.persist()
    if is_small(dim, max_rows):
        return facts.join(F.broadcast(dim), list(keys), how)
    return salted(facts, salts).join(replicated(dim, salts), [*keys, "_salt"], how).drop("_salt")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    start: str,
    end: str,
    bucket: int,
    closed: bool = True,
    how: str = "inner",
    on: Sequence[str] = (),
    max_rows: int = MAX_BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Rows of ``points`` whose time lies in ``[start, end]`` (or ``[start, end)``) of an interval.

    Each interval is listed once per time bucket it touches, so that the range test rides on an equi
    join. The interval side is broadcast after its size was checked and the large table is then
    never shuffled; beyond the bound, buckets are salted because one bucket can hold most points.
    """
    last = F.col(end) if closed else F.col(end) - F.lit(1e-9)
    listed = intervals.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col(start) / bucket).cast("long"), F.floor(last / bucket).cast("long")
            )
        ),
    )
    listed = listed.select(*[F.col(c).alias(f"_r_{c}") for c in listed.columns if c != "_bucket"], "_bucket")
    left = points.withColumn("_bucket", F.floor(F.col(point) / bucket).cast("long"))
    cond = (F.col("l._bucket") == F.col("r._bucket")) & (F.col(f"l.{point}") >= F.col(f"r._r_{start}"))
    upper = F.col(f"r._r_{end}")
    cond &= (F.col(f"l.{point}") <= upper) if closed else (F.col(f"l.{point}") < upper)
    for c in on:
        cond &= F.col(f"l.{c}") == F.col(f"r._r_{c}")
    listed = listed.persist()
    if is_small(listed, max_rows):
        right = F.broadcast(listed)
    else:
        left, right = salted(left, salts), replicated(listed, salts)
        cond &= F.col("l._salt") == F.col("r._salt")
    joined = left.alias("l").join(right.alias("r"), cond, how)
    kept = [F.col(f"l.{c}") for c in points.columns]
    if how in ("inner", "left"):
        kept += [F.col(f"r._r_{c}").alias(c) for c in intervals.columns if c not in points.columns]
    return joined.select(*kept)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows of every group, numbered from 1.

    For small k Spark itself prunes each map partition before the shuffle. For larger k the rows are
    pruned per salted part of the group first, so one hot group never lands whole in one task.
    """
    order = [_as_col(c) for c in order]
    if k > WINDOW_LIMIT:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted(df)
            .withColumn("_rn", F.row_number().over(part))
            .filter(F.col("_rn") <= k)
            .drop("_rn", "_salt")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def global_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Number all rows 0, 1, 2, ... in the given order without one task seeing them all.

    Rows are range partitioned and numbered inside their range; the ranges' sizes (one row each)
    give the offsets. The ranges are checkpointed, so that a recomputed task sees the same bounds.
    """
    order = [_as_col(c) for c in order]
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_part", "_local", "_offset")
    )


def series_index(
    df: DataFrame, keys: Sequence[str], position: str, name: str, block: int = 1 << 24
) -> DataFrame:
    """Number the rows of every key 0, 1, 2, ... along ``position``, whose values are distinct in a key.

    A long series is numbered inside blocks of positions; each block's count, one row, gives the offset
    of the next ones.
    """
    rows = df.withColumn("_block", F.floor(F.col(position) / block).cast("long"))
    counts = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(position)) - 1
    rows = rows.withColumn("_inside", inside).join(offsets, [*keys, "_block"])
    return rows.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_block", "_inside", "_offset")


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    name: str,
    block: int = 65_536,
) -> DataFrame:
    """Carry the last non-null value forward along ``position`` inside each key.

    A key may hold a very long sequence (one log file), so it is worked on in blocks of positions:
    each block's last value is aggregated first, carried over the short list of blocks, and used
    where a block has no own value yet.
    """
    rows = df.withColumn("_v", value).withColumn(
        "_block", F.floor(F.col(position) / block).cast("long")
    )
    marked = F.when(F.col("_v").isNotNull(), F.struct(F.col(position), F.col("_v")))
    ends = rows.groupBy(*keys, "_block").agg(F.max(marked)["_v"].alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = rows.withColumn("_own", F.last("_v", ignorenulls=True).over(inside))
    return (
        rows.join(carry, [*keys, "_block"], "left")
        .withColumn(name, F.coalesce("_own", "_carry"))
        .drop("_v", "_block", "_own", "_carry")
    )


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    task_rows: int = 1_000_000,
    bins: int = 1024,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group; one column per name.

    Equal values are counted before the shuffle. Groups that stay small use the built-in exact
    percentile. For larger ones, histograms narrow down the values around the wanted ranks until
    what is left of the group fits a task.
    """
    counts = cut_lineage(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_x"))
        .agg(F.count("*").alias("_c"))
    )
    stats = counts.groupBy(*keys).agg(F.count("*").alias("_distinct"), F.sum("_c").alias("_n"))
    hot = stats.filter(F.col("_distinct") > task_rows).persist()

    def small(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *[F.percentile("_x", F.lit(p), F.col("_c")).alias(n) for n, p in probs.items()]
        )

    if hot.isEmpty():
        return small(counts)
    hot_keys = hot.select(*keys)
    result = small(lookup_join(counts, hot_keys, keys, "left_anti"))
    hot_result = hot_keys
    for name, p in probs.items():
        # the wanted 0-based rank, and its upper neighbour for the interpolation
        target = hot.select(*keys, ((F.col("_n") - 1) * F.lit(p)).alias("_pos"))
        below = target.withColumn("_below", F.lit(0).cast("long"))
        rows = lookup_join(counts, hot_keys, keys, "inner")
        while True:
            span = rows.groupBy(*keys).agg(
                F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_left")
            )
            span = cut_lineage(span)
            if span.filter((F.col("_left") > task_rows) & (F.col("_hi") > F.col("_lo"))).isEmpty():
                break
            width = (F.col("_hi") - F.col("_lo")) / bins
            binned = lookup_join(rows, span, keys, "inner").withColumn(
                "_bin",
                F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)))
                .otherwise(0)
                .cast("long"),
            )
            binned = cut_lineage(binned.drop("_lo", "_hi", "_left"))
            hist = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_h"))
            upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(
                Window.unboundedPreceding, Window.currentRow
            )
            hist = hist.withColumn("_cum", F.sum("_h").over(upto)).join(below, list(keys))
            first = F.col("_below") + F.col("_cum") - F.col("_h")
            last = F.col("_below") + F.col("_cum") - 1
            wanted = hist.filter((last >= F.floor("_pos")) & (first <= F.ceil("_pos")))
            below = cut_lineage(
                wanted.groupBy(*keys, "_pos").agg(F.min(first).cast("long").alias("_below"))
            )
            kept = cut_lineage(wanted.select(*keys, "_bin"))
            rows = cut_lineage(lookup_join(binned, kept, [*keys, "_bin"], "inner").drop("_bin"))
        upto = Window.partitionBy(*keys).orderBy("_x").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        ranked = rows.withColumn("_cum", F.sum("_c").over(upto)).join(below, list(keys))
        first = F.col("_below") + F.col("_cum") - F.col("_c")
        last = F.col("_below") + F.col("_cum") - 1
        lo = F.max(F.when((first <= F.floor("_pos")) & (last >= F.floor("_pos")), F.col("_x")))
        hi = F.max(F.when((first <= F.ceil("_pos")) & (last >= F.ceil("_pos")), F.col("_x")))
        picked = ranked.groupBy(*keys, "_pos").agg(lo.alias("_a"), hi.alias("_b"))
        frac = F.col("_pos") - F.floor("_pos")
        picked = picked.select(*keys, ((1 - frac) * F.col("_a") + frac * F.col("_b")).alias(name))
        hot_result = hot_result.join(picked, list(keys))
    return result.unionByName(hot_result)


def global_running_sum(
    df: DataFrame, order: Sequence[Column | str], value: str, name: str
) -> DataFrame:
    """Sum of ``value`` over all rows before the current one in a global order (unique order keys).

    Works like ``global_index``: local sums inside ranges plus the totals of the ranges before.
    """
    order = [_as_col(c) for c in order]
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_part", "_local", "_offset")
    )
