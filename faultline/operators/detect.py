"""Anomaly scores of metric windows: squared z errors, thresholds, eta and adaptive tail limits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: tail probability, first level and quantile levels
TAIL_Q = 1e-3
LEVEL_PLAIN = 0.98
LEVEL_DRIFT = 0.8
NO_EXCESS_PEAKS = (0.001, 0.002)
TRAIN_QUANTILE = 0.99
FEATURE_QUANTILE = 0.97

KEYS = ["incident_id", "metric"]


def z_errors(series: DataFrame, train: str, keys=KEYS) -> DataFrame:
    """Squared z of every point against its series' calibration part (deviation 0 becomes 1e-6)."""
    train = F.expr(train)
    whole = Window.partitionBy(*keys)
    v = F.when(train, F.col("value"))
    std = F.stddev_pop(v).over(whole)
    df = series.withColumn("_m", F.avg(v).over(whole)).withColumn("_s", std)
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") == 0, 1e-6).otherwise(F.col("_s"))
    return df.withColumn("train", train).withColumn("error", z * z).drop("_m", "_s")


def step_scores(errors: DataFrame) -> DataFrame:
    """Mean error over all metrics per step, and whether it exceeds the calibration's p99."""
    steps = errors.groupBy("incident_id", "k", "train").agg(F.avg("error").alias("score"))
    limit = F.percentile(F.when(F.col("train"), F.col("score")), F.lit(TRAIN_QUANTILE))
    return steps.withColumn("threshold", limit.over(Window.partitionBy("incident_id"))).withColumn(
        "anomalous", ~F.col("train") & (F.col("score") > F.col("threshold"))
    )


def feature_flags(errors: DataFrame, steps: DataFrame) -> DataFrame:
    """Metrics above their own p97 at anomalous steps."""
    test = errors.filter(~F.col("train"))
    limit = F.percentile("error", F.lit(FEATURE_QUANTILE)).over(Window.partitionBy(*KEYS))
    marked = test.withColumn("limit", limit).filter(F.col("error") > F.col("limit"))
    return marked.join(steps.filter("anomalous").select("incident_id", "k"), ["incident_id", "k"])


def feature_ranking(errors: DataFrame) -> DataFrame:
    """Metrics by total error over the tested steps."""
    return errors.filter(~F.col("train")).groupBy(*KEYS).agg(F.sum("error").alias("total"))


def sigma_thresholds(series: DataFrame, train: str, n_std: float = 3.0) -> DataFrame:
    """Constant limit per series: mean + n_std * max(std, 1e-8) of the calibration part."""
    train = F.expr(train)
    whole = Window.partitionBy(*KEYS)
    v = F.when(train, F.col("value"))
    limit = F.avg(v).over(whole) + n_std * F.greatest(F.stddev_pop(v).over(whole), F.lit(1e-8))
    return series.withColumn("threshold", limit).filter(~train)


def eta(tested: DataFrame, keys=KEYS) -> DataFrame:
    """Per metric the largest relative excess over its threshold, and the first such step.

    A threshold of 0 gives no ratio; a metric without excess has eta 0.
    """
    over = F.col("value") > F.col("threshold")
    ratio = F.try_divide(F.abs(F.col("value") - F.col("threshold")), F.col("threshold"))
    return tested.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(over, ratio)), F.lit(0.0)).alias("eta"),
        F.min(F.when(over, F.col("k"))).alias("first_step"),
    )


def scaled_to(multi: DataFrame, eta_uni: DataFrame) -> DataFrame:
    """Bring total errors into the range of the univariate eta of the same incident."""
    whole = Window.partitionBy("incident_id")
    m, u = F.max("total").over(whole), F.max("eta").over(whole)
    joined = multi.join(eta_uni, KEYS)
    scaled = F.when((m > 0) & (u > 0), F.col("total") / m * u).otherwise(F.col("total"))
    return joined.withColumn("eta_multi", scaled)


def direction_events(series: DataFrame, train: str, keys=KEYS, limit: float = 3.0) -> DataFrame:
    """Metrics whose tested mean abs z exceeds ``limit``, with the direction of the change."""
    train = F.expr(train)
    whole = Window.partitionBy(*keys)
    v = F.when(train, F.col("value"))
    std = F.stddev_pop(v).over(whole)
    df = series.withColumn("_m", F.avg(v).over(whole)).withColumn(
        "_s", F.when(std == 0, 1e-6).otherwise(std)
    )
    z = F.abs((F.col("value") - F.col("_m")) / F.col("_s"))
    return (
        df.filter(~train)
        .groupBy(*keys)
        .agg(F.avg(z).alias("mean_z"), F.avg("value").alias("test_mean"), F.max("_m").alias("train_mean"))
        .withColumn("anomalous", F.col("mean_z") > limit)
        .withColumn("direction", F.when(F.col("test_mean") > F.col("train_mean"), "up").otherwise("down"))
    )


class _Tail:
    """Peaks over a fixed level, kept as count, sum and sum of squares."""

    def __init__(self, calibration: np.ndarray, level: float, q: float):
        ranked = np.sort(calibration)
        self.level = ranked[min(int(level * len(ranked)), len(ranked) - 1)]
        peaks = ranked[ranked > self.level] - self.level
        if len(peaks) == 0:
            peaks = np.array(NO_EXCESS_PEAKS)
        self.n, self.q = len(ranked), q
        self.nt, self.s1, self.s2 = len(peaks), peaks.sum(), (peaks**2).sum()
        self.refit()

    @classmethod
    def restored(cls, n, nt, s1, s2, level, limit, q) -> _Tail:
        """Continue from saved sums; the limit is kept, as it moves with new peaks only."""
        tail = cls.__new__(cls)
        tail.n, tail.nt, tail.s1, tail.s2 = n, nt, s1, s2
        tail.level, tail.limit, tail.q = level, limit, q
        return tail

    def refit(self) -> None:
        # moments estimate of the generalized Pareto tail
        mean = self.s1 / self.nt
        var = max(self.s2 / self.nt - mean * mean, 0.0)
        r = self.n * self.q / self.nt
        if var <= 1e-18:
            self.limit = self.level - mean * math.log(r)
            return
        ratio = mean * mean / var
        shape, scale = 0.5 * (1 - ratio), 0.5 * mean * (1 + ratio)
        if abs(shape) < 1e-12:
            self.limit = self.level - scale * math.log(r)
        else:
            self.limit = self.level + scale / shape * (r**-shape - 1)

    def see(self, x: float) -> bool:
        """Update with one value; True for an alarm, which changes nothing."""
        if x > self.limit:
            return True
        self.n += 1
        if x > self.level:
            peak = x - self.level
            self.nt, self.s1, self.s2 = self.nt + 1, self.s1 + peak, self.s2 + peak * peak
            self.refit()
        return False


#: places at which each side of the likelihood's root function is looked at for a change of sign
SEARCH_POINTS = 96


def fit_pareto(peaks: np.ndarray) -> tuple[float, float]:
    """(shape, scale) of the generalized Pareto distribution with the greatest likelihood for positive peaks.

    With x = shape / scale the shape that fits best is g(x) = mean(log(1 + x y)), and the likelihood is
    -n (log(g(x) / x) + g(x) + 1); its stationary points are the zeros of (1 + g(x)) mean(1 / (1 + x y)) - 1. Both
    sides of 0 are searched, on a grid that is dense near 0 and near the pole at -1 / max(y); each change of sign is
    halved down to a root, so the search cannot leave its bracket. The likelihoods of all roots and of shape 0 (the
    exponential, scale mean(y)) are compared. Shapes below -1, where the likelihood has no bound, are left out.
    """
    y = np.asarray(peaks, float)
    n, mean, top, low = len(y), y.mean(), y.max(), y.min()
    best = (-n * (math.log(mean) + 1), 0.0, mean)
    if top <= low:
        return best[1:]

    def zero(x: np.ndarray) -> np.ndarray:
        z = 1 + np.multiply.outer(x, y)
        return (1 + np.log(z).mean(axis=-1)) * (1 / z).mean(axis=-1) - 1

    steps = np.geomspace(1e-8, 1, SEARCH_POINTS)
    pole = -1 / top
    left = np.unique(np.concatenate((pole * (1 - steps), pole * steps)))
    left = left[(left > pole) & (left < 0)]
    right = 2 * (mean - low) / low**2 * np.geomspace(1e-8 * low / top, 1, 2 * SEARCH_POINTS)
    for grid in (left, right):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            side = np.sign(zero(grid))
        change = np.flatnonzero(side[1:] * side[:-1] < 0)
        a, b, sign = grid[change], grid[change + 1], side[change]
        for _ in range(80):
            middle = (a + b) / 2
            same = np.sign(zero(middle)) == sign
            a, b = np.where(same, middle, a), np.where(same, b, middle)
        for x in (a + b) / 2:
            shape = float(np.log(1 + x * y).mean())
            if shape > -1 and shape / x > 0:
                best = max(best, (-n * (math.log(shape / x) + shape + 1), shape, shape / x))
    return best[1:]


class _LikelihoodTail(_Tail):
    """Peaks over a fixed level, kept one by one, with the tail of the greatest likelihood."""

    def __init__(self, calibration: np.ndarray, level: float, q: float):
        self.peaks = None
        super().__init__(calibration, level, q)
        ranked = np.sort(calibration)
        peaks = ranked[ranked > self.level] - self.level
        self.peaks = list(peaks if len(peaks) else NO_EXCESS_PEAKS)
        self.refit()

    def refit(self) -> None:
        if self.peaks is None:  # while the level is set
            return
        shape, scale = fit_pareto(np.array(self.peaks))
        r = self.n * self.q / len(self.peaks)
        self.limit = self.level + (-scale * math.log(r) if shape == 0 else scale / shape * (r**-shape - 1))

    def see(self, x: float) -> bool:
        if x > self.limit:
            return True
        self.n += 1
        if x > self.level:
            self.peaks.append(x - self.level)
            self.refit()
        return False


TAILS = {"moments": _Tail, "likelihood": _LikelihoodTail}


def tail_limits(values: np.ndarray, n_init: int, q: float, depth: int, two_sided: bool, fit: str = "moments"):
    """Run one series: calibrate on the first n_init values, then follow the rest value by value.

    depth 0 is the plain form; otherwise values are taken relative to the mean of the last
    ``depth`` normal ones. Returns the upper and lower thresholds and the alarms of the rest.
    """
    depth = min(depth, n_init - 1)
    head, rest = values[:n_init], values[n_init:]
    if depth > 0:
        means = np.convolve(head, np.ones(depth) / depth, "valid")[:-1]
        calibration, recent = head[depth:] - means, list(head[-depth:])
        level = LEVEL_DRIFT
    else:
        calibration, recent, level = head, [], LEVEL_PLAIN
    upper = TAILS[fit](calibration, level, q)
    lower = TAILS[fit](-calibration, level, q) if two_sided else None
    ups, lows, alarms = [], [], []
    for x in rest:
        base = sum(recent) / depth if depth else 0.0
        ups.append(float(upper.limit + base))
        lows.append(float(base - lower.limit) if lower else None)
        high_alarm = upper.see(x - base)
        low_alarm = lower.see(base - x) if lower and not high_alarm else False
        alarms.append(bool(high_alarm or low_alarm))
        if depth and not alarms[-1]:
            recent = recent[1:] + [x]
    return ups, lows, alarms


def as_arrays(series: DataFrame, keys=KEYS) -> DataFrame:
    """One row per bounded series: its positions and values in order."""
    points = F.array_sort(F.collect_list(F.struct("k", "value")))
    return series.groupBy(*keys).agg(points.alias("_p")).select(
        *keys, F.col("_p.k").alias("ks"), F.col("_p.value").alias("vs")
    )


def adaptive_thresholds(
    series: DataFrame,
    q: float = TAIL_Q,
    depth: int = 0,
    two_sided: bool = False,
    train_share: float = 0.5,
    keys: list[str] = KEYS,
    fit: str = "moments",
) -> DataFrame:
    """Adaptive tail thresholds per series (``keys``); series length is bounded by the window.

    ``fit`` is "moments" or "likelihood" (``fit_pareto``). A threshold follows from all values before it, so one
    series is one sequence; series are spread over the cluster. A series on which the tail fit fails falls back
    to mean + 3 std.
    """

    @F.pandas_udf("struct<up: array<double>, low: array<double>, alarm: array<boolean>>")
    def limits(vs: pd.Series) -> pd.DataFrame:
        rows = []
        for v in vs:
            x = np.asarray(v, float)
            n_init = int(train_share * len(x))
            try:
                rows.append(tail_limits(x, n_init, q, depth, two_sided, fit))
            except (ValueError, ZeroDivisionError, OverflowError, IndexError):
                limit = float(x[:n_init].mean() + 3 * max(x[:n_init].std(), 1e-8))
                rest = x[n_init:]
                rows.append(([limit] * len(rest), [None] * len(rest), [bool(a > limit) for a in rest]))
        return pd.DataFrame(rows, columns=["up", "low", "alarm"])

    n = series.sparkSession.conf.get("spark.sql.shuffle.partitions")
    arrays = as_arrays(series.repartition(int(n), *keys), keys).withColumn("r", limits("vs"))
    n_init = F.floor(F.size("vs") * F.lit(train_share)).cast("int")
    at = F.col("_i") + n_init
    return arrays.select("*", F.posexplode("r.up").alias("_i", "threshold")).select(
        *keys,
        F.get("ks", at).alias("k"),
        F.get("vs", at).alias("value"),
        "threshold",
        F.get("r.low", F.col("_i")).alias("lower"),
        F.get("r.alarm", F.col("_i")).alias("alarm"),
    )
