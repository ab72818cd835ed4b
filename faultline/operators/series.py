"""Time-series operators. A series is (keys, t, value); its length is bounded by the time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], t: str = "t"):
    return Window.partitionBy(*keys).orderBy(t)


def back(keys, t="t"):
    return ordered(keys, t).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead(keys, t="t"):
    return ordered(keys, t).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def bin_sums(df: DataFrame, keys, n: int) -> DataFrame:
    """Sums of n consecutive samples as differences of the running sum.

    The first bin covers items 1..n (item 0 is the subtracted start), the k-th items kn..kn+n-1;
    an incomplete last bin is left out. t counts from 0.
    """
    length = df.groupBy(*keys).agg((F.max("t") + 1).alias("_len"))
    first = F.when((F.col("t") >= 1) & (F.col("t") <= n), F.lit(0))
    later = F.when(F.col("t") >= n, F.floor(F.col("t") / n))
    bins = F.explode(F.filter(F.array(first.cast("long"), later.cast("long")), lambda x: x.isNotNull()))
    complete = (F.col("bin") + 1) * n <= F.col("_len")
    return (
        df.join(length, list(keys))
        .withColumn("bin", bins)
        .filter(complete)
        .groupBy(*keys, "bin")
        .agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    )


def on_grid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every series on the union of all times; missing values are null."""
    times = df.select(F.array_sort(F.collect_set("t")).alias("ts")).scalar()
    grid = df.select(*keys).distinct().withColumn("t", F.explode(times))
    return grid.join(df.select(*keys, "t", "value"), [*keys, "t"], "left")


def fill(df: DataFrame, keys, value: str = "value") -> DataFrame:
    """Forward fill, then backward fill, then 0."""
    filled = F.coalesce(
        F.last(value, ignorenulls=True).over(back(keys)),
        F.first(value, ignorenulls=True).over(ahead(keys)),
        F.lit(0.0),
    )
    return df.withColumn("filled", filled)


def zero_fill(df: DataFrame, keys, method: str = "prevlatter") -> DataFrame:
    """Replace zeros from their neighbours in the series; ``filled`` holds the result.

    prevlatter carries the previous value on, then the next one back. linear, nearest, previous and
    next interpolate between non-zero neighbours and extend beyond the ends.
    """
    known = F.nullif(F.col("value"), F.lit(0.0))
    df = df.withColumn("_known", known)
    if method == "prevlatter":
        return fill(df, keys, "_known").drop("_known")
    point = F.when(F.col("_known").isNotNull(), F.struct("t", F.col("_known").alias("v")))
    before = F.last(point, ignorenulls=True).over(back(keys))
    after = F.first(point, ignorenulls=True).over(ahead(keys))
    df = df.withColumn("_b", before).withColumn("_a", after)
    gap_b, gap_a = F.col("t") - F.col("_b.t"), F.col("_a.t") - F.col("t")
    if method == "previous":
        out = F.coalesce("_b.v", "_a.v")
    elif method == "next":
        out = F.coalesce("_a.v", "_b.v")
    elif method == "nearest":
        out = F.when(gap_b.isNull() | (gap_a < gap_b), F.col("_a.v")).otherwise(F.col("_b.v"))
    elif method == "linear":
        ends = Window.partitionBy(*keys)
        pts = F.array_sort(F.collect_list(point).over(ends))
        lo1, lo2 = F.get(pts, F.lit(0)), F.get(pts, F.lit(1))
        hi1, hi2 = F.try_element_at(pts, F.lit(-1)), F.try_element_at(pts, F.lit(-2))

        def line(p, q):
            slope = F.try_divide(q["v"] - p["v"], q["t"] - p["t"])
            return p["v"] + slope * (F.col("t") - p["t"])

        out = (
            F.when(gap_b == 0, F.col("_b.v"))
            .when(F.col("_b").isNull(), line(lo1, lo2))
            .when(F.col("_a").isNull(), line(hi2, hi1))
            .otherwise(line(F.col("_b"), F.col("_a")))
        )
    else:
        raise ValueError(f"unknown method {method}")
    return df.withColumn("filled", out).drop("_known", "_b", "_a")


def zscore(df: DataFrame, keys, calibrate: Column | None = None) -> DataFrame:
    """(x - mean) / population std; the statistics come from rows where ``calibrate`` holds.

    A deviation of 0 becomes 1e-6.
    """
    v = F.col("value") if calibrate is None else F.when(calibrate, F.col("value"))
    whole = Window.partitionBy(*keys)
    std = F.stddev_pop(v).over(whole)
    df = df.withColumn("_m", F.avg(v).over(whole))
    df = df.withColumn("_s", F.when(std == 0, 1e-6).otherwise(std))
    return df.withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def is_train(keys, t: str = "t") -> Column:
    """First half of the series calibrates, by position."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return F.row_number().over(ordered(keys, t)) <= F.floor(n / 2)


def clean(df: DataFrame, keys, clip: float = 10.0) -> DataFrame:
    """Drop constant series, z-score the rest, NaN to 0, clip to +-10."""
    whole = Window.partitionBy(*keys)
    v = F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("_v", v)
    df = df.withColumn("_m", F.avg("_v").over(whole)).withColumn("_s", F.stddev_pop("_v").over(whole))
    z = (F.col("_v") - F.col("_m")) / F.col("_s")
    return (
        df.filter(F.col("_s") > 0)
        .withColumn("z", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.nanvl(z, F.lit(0.0)))))
        .drop("_v", "_m", "_s")
    )


def lag_windows(df: DataFrame, keys, width: int) -> DataFrame:
    """The ``width`` values before each row, oldest first; early rows repeat the first value."""
    w = ordered(keys)
    first = F.first("value").over(back(keys))
    prior = F.collect_list("value").over(w.rowsBetween(-width, -1))
    pad = F.array_repeat(first, F.lit(width) - F.size(prior))
    return df.withColumn("window", F.concat(pad, prior))


def moving_mean(df: DataFrame, keys, d: int) -> DataFrame:
    """Mean of the last d values, from the d-th row on."""
    w = ordered(keys)
    return (
        df.withColumn("mean", F.avg("value").over(w.rowsBetween(-(d - 1), 0)))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") >= d)
        .drop("_rn")
    )


def shape(df: DataFrame, keys, t: str = "k", value: str = "value") -> DataFrame:
    """Shape facts of each series: ends, range, halves, peaks and dips, one row per series."""
    w = ordered(keys, t)
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    rows = df.withColumn("_peak", F.when((v > prev) & (v > nxt), 1).otherwise(0))
    rows = rows.withColumn("_dip", F.when((v < prev) & (v < nxt), 1).otherwise(0))
    rows = rows.withColumn("_step", F.abs(v - prev))
    rows = rows.withColumn("_rn", F.row_number().over(w) - 1)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("_m", F.avg(value).over(whole))
    rows = rows.withColumn("_s", F.stddev_pop(value).over(whole))
    pre = F.col("_rn") < F.floor(F.col("_n") / 2)
    high, low = v > F.col("_m") + 2 * F.col("_s"), v < F.col("_m") - 2 * F.col("_s")
    high_t, low_t = F.when(high, F.col(t)), F.when(low, F.col(t))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(value, t).alias("first"),
        F.max_by(value, t).alias("last"),
        F.min(value).alias("vmin"),
        F.max(value).alias("vmax"),
        F.avg(value).alias("vmean"),
        F.stddev_pop(value).alias("vstd"),
        F.max("_step").alias("max_step"),
        F.sum("_peak").alias("peaks"),
        F.sum("_dip").alias("dips"),
        F.avg(F.when(pre, v)).alias("pre_mean"),
        F.avg(F.when(~pre, v)).alias("post_mean"),
        F.count(high_t).alias("n_high"),
        F.count(low_t).alias("n_low"),
        (F.max(high_t) - F.min(high_t)).alias("high_span"),
        (F.max(low_t) - F.min(low_t)).alias("low_span"),
    )


def percent_change(now: Column, then: Column) -> Column:
    """Percent change with a guard for a start near zero."""
    return F.when(F.abs(then) > 1e-10, (now - then) / F.abs(then) * 100).otherwise((now - then) * 100)


def series_features(df: DataFrame, keys, t: str = "t") -> DataFrame:
    """Eight scale-free features per series; all 0 when the series is flat."""
    whole = Window.partitionBy(*keys)
    w = ordered(keys, t)
    rel = df.withColumn("_rel", F.col("value") / (F.avg(F.abs("value")).over(whole) + 1e-8))
    rel = rel.withColumn("_step", F.col("_rel") - F.lag("_rel").over(w))
    turn = F.signum("_step") != F.lag(F.signum("_step")).over(w)
    rel = rel.withColumn("_turn", F.when(turn, 1).otherwise(0))
    flat = F.stddev_pop("value") < 1e-8
    raw = {
        "rel_mean": F.avg("_rel"),
        "rel_std": F.stddev_pop("_rel"),
        "rel_max": F.max("_rel"),
        "rel_min": F.min("_rel"),
        "iqr": F.percentile("_rel", F.lit(0.75)) - F.percentile("_rel", F.lit(0.25)),
        "volatility": F.coalesce(F.avg(F.abs("_step")), F.lit(0.0)),
        "trend": F.max_by("_rel", t) - F.min_by("_rel", t),
        "turns": F.sum("_turn").cast("double"),
    }
    return rel.groupBy(*keys).agg(*[F.when(flat, 0.0).otherwise(c).alias(n) for n, c in raw.items()])
