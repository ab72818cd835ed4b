"""Skew-safe helpers against brute force, on the broadcast path and on the shuffled one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from faultline.operators import scale
from faultline.operators.windows import nearest_join, point_windows


@pytest.fixture(scope="module")
def points(spark):
    random.seed(1)
    # a third of all points share one second
    data = [(i, 500 if i % 3 == 0 else random.randrange(1000)) for i in range(300)]
    return data, spark.createDataFrame(data, "id long, ts long")


@pytest.fixture(scope="module")
def windows(spark):
    random.seed(2)
    data = [(i, s, s + random.choice([0, 10, 60])) for i, s in enumerate(random.sample(range(1000), 20))]
    data.append((99, 490, 500))
    return data, spark.createDataFrame(data, "w long, a long, b long")


@pytest.mark.parametrize("max_rows", [10_000, 0])
@pytest.mark.parametrize("closed", [True, False])
def test_interval_join(points, windows, max_rows, closed):
    got = scale.interval_join(points[1], windows[1], "ts", "a", "b", 50, closed=closed, max_rows=max_rows, salts=4)
    want = [
        (i, w) for i, ts in points[0] for w, a, b in windows[0] if a <= ts and (ts <= b if closed else ts < b)
    ]
    assert rows(got, "id", "w") == sorted(want, key=str)


@pytest.mark.parametrize("max_rows", [10_000, 0])
def test_interval_anti_join(points, windows, max_rows):
    got = scale.interval_join(
        points[1], windows[1], "ts", "a", "b", 50, closed=False, how="left_anti", max_rows=max_rows, salts=4
    )
    want = [(i,) for i, ts in points[0] if not any(a <= ts < b for _, a, b in windows[0])]
    assert rows(got, "id") == sorted(want, key=str)


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_join_paths_agree(spark, points, how):
    dim = spark.createDataFrame([(500, "hot"), (7, "x")], "ts long, name string")
    small = scale.lookup_join(points[1], dim, ["ts"], how)
    salted = scale.lookup_join(points[1], dim, ["ts"], how, max_rows=0, salts=5)
    assert rows(small, "id") == rows(salted, "id")
    assert salted.count() == points[1].join(dim, "ts", how).count()


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k(spark, k):
    data = [("hot", i * 7 % 2003) for i in range(2003)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(data, "g string, v int")
    got = rows(scale.top_k(df, ["g"], ["v"], k), "g", "v", "rank")
    want = [("hot", i, i + 1) for i in range(min(k, 2003))] + [("cold", i, i + 1) for i in range(min(k, 5))]
    assert got == sorted(want, key=str)


def test_global_index_and_running_sum(spark):
    values = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = {r["v"]: r["i"] for r in scale.global_index(df, ["v"], "i").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    sums = {r["v"]: r["s"] for r in scale.global_running_sum(df, ["v"], "v", "s").collect()}
    want, total = {}, 0
    for v in sorted(values):
        want[v] = total
        total += v
    assert sums == want


def test_running_last_crosses_blocks(spark):
    marks = {3: "a", 40: "b", 41: "c", 95: "d"}
    df = spark.createDataFrame([("f", i, marks.get(i)) for i in range(120)], "f string, pos long, m string")
    got = {r["pos"]: r["c"] for r in scale.running_last(df, ["f"], "pos", F.col("m"), "c", block=10).collect()}
    last, want = None, {}
    for i in range(120):
        last = marks.get(i, last)
        want[i] = last
    assert got == want


@pytest.mark.parametrize("task_rows", [1_000_000, 20])
def test_grouped_quantiles(spark, task_rows):
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.exponential(3, 400), np.full(100, 2.5), [1e6]])
    cold = rng.normal(size=11)
    data = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold] + [("one", 4.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {
        r["g"]: (r["a"], r["b"])
        for r in scale.grouped_quantiles(df, ["g"], "x", {"a": 0.5, "b": 0.97}, task_rows=task_rows, bins=8).collect()
    }
    for g, x in (("hot", hot), ("cold", cold), ("one", [4.0])):
        assert got[g] == pytest.approx(tuple(np.percentile(x, [50, 97])), rel=1e-12)


def test_nearest_join(spark):
    random.seed(4)
    left = [(i, random.choice("ab"), random.randrange(200)) for i in range(80)]
    right = [(random.choice("ab"), random.randrange(200), f"r{i}") for i in range(15)]
    got = nearest_join(
        spark.createDataFrame(left, "id long, k string, ts long"),
        spark.createDataFrame(right, "k string, rts long, name string"),
        "ts", "rts", "name", ["k"], tolerance=12,
    )
    want = {}
    for i, k, ts in left:
        near = sorted((abs(r - ts), r, n) for kk, r, n in right if kk == k and abs(r - ts) <= 12)
        want[i] = (near[0][2], near[0][0]) if near else (None, None)
    assert {r["id"]: (r["name"], r["distance"]) for r in got.collect()} == want


def test_point_windows_go_by_position_however_sparse(spark):
    day = 86_400
    data = [("daily", i * day, float(i)) for i in range(60)] + [("short", i * day, 0.0) for i in range(29)]
    points = spark.createDataFrame(data, "metric string, ts long, value double")
    faults = [(1, 40 * day + 5), (2, -9 * day), (3, 900 * day)]
    incidents = spark.createDataFrame(faults, "incident_id long, fault_ts long")
    found = point_windows(points, incidents, ["metric"]).select("incident_id", "metric", "k", "value", "nearest_pos")
    firsts = {1: (25, 40), 2: (0, 0), 3: (30, 59)}
    want = [(i, "daily", k, float(at + k), mid) for i, (at, mid) in firsts.items() for k in range(30)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("block", [1, 7, 1 << 24])
def test_series_index_counts_over_blocks(spark, block):
    random.seed(3)
    data = [(k, ts) for k in "abc" for ts in random.sample(range(-500, 500), 40)]
    got = scale.series_index(spark.createDataFrame(data, "k string, ts long"), ["k"], "ts", "pos", block)
    want = [(k, ts, i) for k in "abc" for i, ts in enumerate(sorted(t for x, t in data if x == k))]
    assert sorted(map(tuple, got.select("k", "ts", "pos").collect())) == want
