"""Generalized Pareto tails by likelihood, against a grid of shapes and scales."""

import numpy as np
import pytest

from faultline.operators import detect


def pareto(rng, shape, scale, n):
    u = rng.uniform(size=n)
    return -scale * np.log(u) if shape == 0 else scale / shape * (u**-shape - 1)


def log_likelihood(y, shape, scale):
    if abs(shape) < 1e-12:
        return -len(y) * np.log(scale) - y.sum() / scale
    z = 1 + shape * y / scale
    return -np.inf if (z <= 0).any() else -len(y) * np.log(scale) - (1 + 1 / shape) * np.log(z).sum()


@pytest.mark.parametrize("shape", [-0.4, -0.1, 0.0, 0.2, 0.8])
@pytest.mark.parametrize("n", [5, 30, 400])
def test_no_shape_and_scale_of_a_grid_fits_better(shape, n):
    rng = np.random.default_rng(int(100 * shape) + n + 50)
    y = pareto(rng, shape, 2.0, n)
    got = log_likelihood(y, *detect.fit_pareto(y))
    grid = max((log_likelihood(y, g, s), g) for g in np.linspace(-0.95, 3, 159) for s in np.geomspace(0.05, 40, 120))
    # few peaks can have no maximum inside: their likelihood then grows down to shape -1, and a stationary point counts
    assert got >= grid[0] - 1e-9 or (n == 5 and grid[1] < -0.9)
    if n == 400:
        assert detect.fit_pareto(y)[0] == pytest.approx(shape, abs=0.25)


def test_fit_scales_with_the_data_and_handles_equal_peaks():
    y = pareto(np.random.default_rng(3), 0.3, 1.0, 80)
    (g, s), (g3, s3) = detect.fit_pareto(y), detect.fit_pareto(3 * y)
    assert g3 == pytest.approx(g, abs=1e-7) and s3 == pytest.approx(3 * s, rel=1e-7)
    assert detect.fit_pareto(np.array([2.0, 2.0])) == (0.0, 2.0)


def by_hand(x, n_init, q, depth):
    """One-sided thresholds value by value, fitted anew on all peaks with every new one."""
    depth = min(depth, n_init - 1)
    if depth:
        base = [np.mean(x[i - depth : i]) for i in range(depth, n_init)]
        head, recent, level = x[depth:n_init] - base, list(x[n_init - depth : n_init]), detect.LEVEL_DRIFT
    else:
        head, recent, level = x[:n_init], [], detect.LEVEL_PLAIN
    bar = np.sort(head)[int(level * len(head))]
    peaks, n, out = [v - bar for v in head if v > bar], len(head), []

    def limit():
        g, s = detect.fit_pareto(np.array(peaks or detect.NO_EXCESS_PEAKS))
        r = n * q / (len(peaks) or 2)
        return bar + (-s * np.log(r) if g == 0 else s / g * (r**-g - 1))

    now = limit()
    for v in x[n_init:]:
        mean = np.mean(recent) if depth else 0.0
        out.append(now + mean)
        if v - mean > now:  # an alarm changes nothing
            continue
        n += 1
        if v - mean > bar:
            peaks.append(v - mean - bar)
            now = limit()  # a value below the level only counts
        recent = [*recent[1:], v] if depth else recent
    return out


@pytest.mark.parametrize("depth", [0, 10])
def test_thresholds_follow_the_peaks(spark, depth):
    rng = np.random.default_rng(6)
    x = rng.exponential(size=800) + np.linspace(0, 3, 800)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, 2 * float(v)) for i, v in enumerate(x)], "metric string, k long, value double")
    out = detect.adaptive_thresholds(df, depth=depth, keys=["metric"], fit="likelihood").orderBy("k").collect()
    a = [r.threshold for r in out if r.metric == "a"]
    assert a == pytest.approx(by_hand(x, 400, detect.TAIL_Q, depth), rel=1e-6)
    assert [r.threshold for r in out if r.metric == "b"] == pytest.approx([2 * v for v in a], rel=1e-6)
    assert len(set(np.round(a, 9))) > 5  # it moves


def test_both_sides(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=600)
    x[500] = -12
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "metric string, k long, value double")
    rows = {r.k: r for r in detect.adaptive_thresholds(df, two_sided=True, keys=["metric"], fit="likelihood").collect()}
    assert rows[500].alarm and rows[500].lower > -12 and sum(r.alarm for r in rows.values()) < 10
