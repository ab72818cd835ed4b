import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import detect, patterns
from faultline.operators import series as se


def one(spark, values, key="m"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "metric string, t long, value double")


def col(df, name, order="t"):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize(
    "method,want",
    [
        ("prevlatter", [2, 2, 2, 2, 2, 6, 6]),
        ("previous", [2, 2, 2, 2, 2, 6, 6]),
        ("next", [2, 2, 6, 6, 6, 6, 6]),
        ("nearest", [2, 2, 2, 2, 6, 6, 6]),
        ("linear", [1, 2, 3, 4, 5, 6, 7]),
    ],
)
def test_zero_fill(spark, method, want):
    got = col(se.zero_fill(one(spark, [0, 2, 0, 0, 0, 6, 0]), ["metric"], method), "filled")
    assert got == pytest.approx(want)


def test_all_zero_stays_zero(spark):
    assert col(se.zero_fill(one(spark, [0, 0, 0]), ["metric"]), "filled") == [0, 0, 0]


def test_bin_sums(spark):
    # items 0..7 with n = 3: items 1..3, then 3..5; the third bin is incomplete
    got = {r["bin"]: r["total"] for r in se.bin_sums(one(spark, range(8)), ["metric"], 3).collect()}
    assert got == {0: 6.0, 1: 12.0}


def test_lag_windows_repeat_first(spark):
    got = col(se.lag_windows(one(spark, [5, 6, 7, 8]), ["metric"], 2), "window")
    assert got == [[5, 5], [5, 5], [5, 6], [6, 7]]


def test_constant_series_is_cleaned_away(spark):
    both = one(spark, [3, 3, 3], "flat").unionByName(one(spark, [1, 2, 30], "live"))
    out = se.clean(both, ["metric"]).collect()
    assert {r["metric"] for r in out} == {"live"}


def test_zscore_of_flat_train_half(spark):
    df = one(spark, [1, 1, 5, 6]).withColumn("train", F.col("t") < 2)
    assert col(se.zscore(df, ["metric"], F.col("train")), "z")[2] == pytest.approx(4e6)


def test_shape_counts(spark):
    v = [1, 3, 2, 5, 0, 4]
    r = se.shape(one(spark, v), ["metric"], "t").collect()[0]
    assert (r["peaks"], r["dips"], r["first"], r["last"]) == (2, 2, 1.0, 4.0)
    assert r["pre_mean"] == 2.0 and r["post_mean"] == 3.0


def test_series_features(spark):
    v = np.array([1.0, 4.0, 2.0, 7.0, 3.0])
    r = se.series_features(one(spark, v), ["metric"]).collect()[0]
    rel = v / (np.abs(v).mean() + 1e-8)
    assert r["iqr"] == pytest.approx(np.percentile(rel, 75) - np.percentile(rel, 25))
    assert r["volatility"] == pytest.approx(np.abs(np.diff(rel)).mean())
    assert r["turns"] == 3.0
    flat = se.series_features(one(spark, [2, 2, 2]), ["metric"]).collect()[0]
    assert [flat[c] for c in ("rel_mean", "iqr", "turns")] == [0, 0, 0]


def windows(spark, values):
    return spark.createDataFrame(
        [(1, "m", i, float(v)) for i, v in enumerate(values)], "incident_id long, metric string, k long, value double"
    )


@pytest.mark.parametrize("depth,two_sided", [(0, False), (0, True), (5, False), (5, True)])
def test_tail_threshold_flags_a_spike(spark, depth, two_sided):
    rng = np.random.default_rng(0)
    v = rng.normal(10, 1, 60)
    v[45] = 80
    v[50] = -80
    out = {r["k"]: r for r in detect.adaptive_thresholds(windows(spark, v), depth=depth, two_sided=two_sided).collect()}
    assert len(out) == 30 and out[45]["alarm"]
    assert out[50]["alarm"] == two_sided
    assert (out[50]["lower"] is not None) == two_sided


def test_alarm_changes_no_state(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, 40)
    spiked = v.copy()
    spiked[30] = 1e4
    a = {r["k"]: r["threshold"] for r in detect.adaptive_thresholds(windows(spark, v), depth=5).collect()}
    b = {r["k"]: r["threshold"] for r in detect.adaptive_thresholds(windows(spark, spiked), depth=5).collect()}
    assert all(a[k] == pytest.approx(b[k]) for k in range(20, 31))


def test_constant_series_gets_a_threshold(spark):
    out = detect.adaptive_thresholds(windows(spark, [3.0] * 20), depth=300).collect()
    assert len(out) == 10 and not any(r["alarm"] for r in out)


def test_eta_with_zero_threshold(spark):
    df = windows(spark, [1, 2]).withColumn("threshold", F.lit(0.0))
    r = detect.eta(df).collect()[0]
    assert r["eta"] == 0.0 and r["first_step"] == 0


@pytest.mark.parametrize(
    "values,name",
    [
        ([1] * 15 + [9] * 15, "Level shift up"),
        ([9] * 15 + [1] * 15, "Level shift down"),
        ([1, 2] * 7 + [1, 30] + [1, 2] * 7, "Single spike"),
        ([30, 29] * 7 + [30, 1] + [30, 29] * 7, "Single dip"),
        (list(range(30)), "Steady increase"),
    ],
)
def test_pattern_classes(spark, values, name):
    shape = se.shape(windows(spark, values), ["incident_id", "metric"])
    n = shape.select(patterns.pattern_class().alias("c")).collect()[0]["c"]
    assert patterns.PATTERNS[n] == name


def test_descriptions_name_their_facts(spark):
    shape = (
        se.shape(windows(spark, [1, 2] * 7 + [1, 30] + [1, 2] * 7), ["incident_id", "metric"])
        .withColumn("base_mean", F.lit(1.5)).withColumn("base_std", F.lit(2.0))
        .withColumn("kpi", F.lit("cpu")).withColumn("service", F.lit("svc1"))
        .withColumn("start", F.lit("2021-07-01 10:00:00")).withColumn("minutes", F.lit(15))
    )
    r = patterns.describe(patterns.deviation_scores(shape)).collect()[0]
    assert r["score"] == 7.13 and r["severity"] == "critical"
    assert r["description"] == (
        "svc1, cpu: one peak of 30.0000 near 2021-07-01 10:00:00, 14.3σ over 1.5000; it began at 1.0000 "
        "and was over in 15 min. Severity: [CRITICAL]."
    )
