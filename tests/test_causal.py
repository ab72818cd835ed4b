import numpy as np
import pytest

from conftest import rows
from faultline.operators import causal, graphs, messages, vectors
from pyspark.sql import functions as F


def series(spark, x, incident=1):
    data = [(incident, f"m{i}", t, float(v)) for i, row in enumerate(x) for t, v in enumerate(row)]
    return spark.createDataFrame(data, "incident_id long, metric string, k long, value double")


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(7)
    cause = rng.normal(size=80)
    effect = np.roll(cause, 2) + 0.1 * rng.normal(size=80)
    return np.array([cause, effect, rng.normal(size=80), np.ones(80)])


def test_correlations(spark, signals):
    got = {(r.a, r.b): r.r for r in causal.correlations(series(spark, signals)).collect()}
    assert got[("m0", "m2")] == pytest.approx(np.corrcoef(signals[0], signals[2])[0, 1])
    assert got[("m0", "m0")] == 0.0 and got[("m0", "m3")] == 0.0


def test_links_find_cause_and_lag(spark, signals):
    found = rows(causal.lagged_links(series(spark, signals)), "src", "dst", "lag")
    assert ("m0", "m1", 2) in found
    coded = rows(causal.lagged_links(series(spark, signals), as_coded=True), "src", "dst", "lag")
    assert sorted((d, s, lag) for s, d, lag in coded) == sorted(found)


def test_partial_correlation_is_that_of_residuals(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(2, 50))
    x = z.sum(axis=0) + rng.normal(size=50)
    y = z.sum(axis=0) - 0.5 * x + rng.normal(size=50)
    schema = "x array<double>, y array<double>, a array<double>, b array<double>, flat array<double>"
    df = spark.createDataFrame([(x.tolist(), y.tolist(), *z.tolist(), [5.0] * 50)], schema)
    x_, y_, a, b, flat = (F.col(c) for c in df.columns)
    row = df.select(
        vectors.partial_correlation(x_, y_, F.array(a, b, a, flat)).alias("r"),  # the second a and flat take nothing out
        vectors.partial_correlation(x_, a, F.array(a, b)).alias("explained"),
        vectors.partial_correlation(x_, flat).alias("flat"),
    ).first()
    design = np.vstack([z, np.ones(50)]).T
    rx = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    ry = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert row.r == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    assert row.flat is None and row.explained is None


def test_transition_rows_sum_to_one(spark, signals):
    s = series(spark, signals)
    entries = spark.createDataFrame([(1, "m1")], "incident_id long, entry string")
    moves = causal.transition(s, causal.lagged_links(s), entries)
    sums = moves.groupBy("src").sum("p").collect()
    assert sums and all(r[1] == pytest.approx(1.0) for r in sums)


def test_expected_visits(spark):
    moves = spark.createDataFrame(
        [(1, "a", "b", 1.0), (1, "b", "a", 0.5), (1, "b", "c", 0.5)], "incident_id long, src string, dst string, p double"
    )
    entries = spark.createDataFrame([(1, "a")], "incident_id long, entry string")
    got = {r.node: r.visits for r in causal.expected_visits(moves, entries, walks=8, steps=3).collect()}
    # step 1: b 8; step 2: a 4, c 4; step 3: b 4
    assert got == {"b": 12.0, "a": 4.0, "c": 4.0}
    assert sum(got.values()) <= 8 * 3


def test_gamma_falls_back_to_eta(spark):
    eta = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 0.0)], "incident_id long, metric string, eta double")
    visits = spark.createDataFrame([(1, "b", 10.0)], "incident_id long, node string, visits double")
    got = {(r.incident_id, r.metric): r.gamma for r in causal.gamma(visits, eta).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.75, (2, "a"): 0.0}


def test_paths_visit_a_node_once(spark):
    links = spark.createDataFrame(
        [(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "c", "d"), (1, "d", "e"), (1, "b", "a")],
        "incident_id long, src string, dst string",
    )
    sources = spark.createDataFrame([(1, 1, "a")], "incident_id long, source_rank int, metric string")
    got = [r.path for r in causal.propagation_paths(links, sources).orderBy("pos").collect()]
    assert got == ["a → b", "a → c", "a → c → d", "a → c → d → e"]


def test_service_walk_prefers_the_correlated_service(spark):
    corr = spark.createDataFrame([(1, "x", 0.9), (1, "y", 0.1)], "incident_id long, service string, r double")
    edges = spark.createDataFrame([(1, "front", "x"), (1, "front", "y")], "incident_id long, src string, dst string")
    got = {r.service: r.score for r in causal.service_walk(edges, corr, "front").collect()}
    assert got["x"] > got["y"]


def test_graph_operators(spark):
    nodes = spark.createDataFrame([(1, n, float(i)) for i, n in enumerate("abcde")], "incident_id long, node string, f double")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "c", "b"), (1, "b", "d")], "incident_id long, src string, dst string")
    loops = set(rows(graphs.add_self_loops(nodes, edges), "src", "dst")) - set(rows(edges, "src", "dst"))
    assert loops == {("a", "a"), ("c", "c"), ("e", "e")}
    mean = {r.node: r.nf for r in graphs.neighbour_mean(nodes, edges, ["f"]).collect()}
    assert mean == {"a": 0.0, "b": 1.0, "c": 0.0, "d": 1.0, "e": 0.0}
    roots = spark.createDataFrame([(1, "b")], "incident_id long, root string")
    kept, inner = graphs.drop_nodes(nodes, edges, roots, share=0.5)
    names = {r.node for r in kept.collect()}
    assert "b" in names and len(names) == 3
    assert {r.node_id for r in kept.collect()} == {0, 1, 2}
    assert all(r.src in names and r.dst in names for r in inner.collect())


def brute_condition_sets(x, max_lag, critical, max_order=None):
    """The level-wise search with least squares; {(src, dst, lag): (partial, n_conditions)}."""
    m, size = x.shape
    reach = min(max_lag, size - 5)
    n = size - reach
    lagged = {(i, lag): x[i, reach - lag : size - lag] for i in range(m) for lag in range(reach + 1)}

    def partial(a, b, given):
        design = np.column_stack([*(lagged[g] for g in given), np.ones(n)])
        ra, rb = (v - design @ np.linalg.lstsq(design, v, rcond=None)[0] for v in (lagged[a], lagged[b]))
        return ra @ rb / np.sqrt((ra @ ra) * (rb @ rb))

    strong = lambda r, k: abs(np.arctanh(r)) * np.sqrt(n - k - 3) > critical
    out = {}
    for j in range(m):
        parents = {}
        for i in range(m):
            for lag in range(1, reach + 1):
                r = partial((i, lag), (j, 0), [])
                if strong(r, 0):
                    parents[i, lag] = (abs(r), r, 0)
        k = 0
        while k != max_order and len(parents) > (k := k + 1) and n - k - 3 > 0:
            ranked = sorted(parents, key=lambda p: (-parents[p][0], p))
            for p in ranked:
                r = partial(p, (j, 0), [q for q in ranked if q != p][:k])
                parents[p] = (min(parents[p][0], abs(r)), r, k) if strong(r, k) else None
            parents = {p: v for p, v in parents.items() if v}
        out |= {(f"m{i}", f"m{j}", lag): v[1:] for (i, lag), v in parents.items() if i != j}
    return out


@pytest.mark.parametrize("max_order", [0, 1, 2, None])
def test_condition_sets_equal_the_search_by_least_squares(spark, max_order):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6, 40)).cumsum(axis=1)
    want = brute_condition_sets(x, 4, causal.CRITICAL_Z, max_order)
    got = {(r.src, r.dst, r.lag): (r.partial, r.n_conditions) for r in causal.condition_set_links(series(spark, x), 4, max_order=max_order).collect()}
    assert got.keys() == want.keys()
    for key, (r, k) in want.items():
        assert got[key] == (pytest.approx(r, abs=1e-9), k)


def test_condition_sets_drop_a_confounder_and_a_chain(spark):
    rng = np.random.default_rng(5)
    t = 200
    noise = lambda s: s * rng.normal(size=t)
    c = rng.normal(size=t)
    early, late = np.roll(c, 1) + noise(0.3), np.roll(c, 3) + noise(0.3)  # both from c
    first = rng.normal(size=t)
    second = np.roll(first, 1) + noise(0.3)
    third = np.roll(second, 1) + noise(0.3)
    x = np.array([c, early, late, first, second, third, np.ones(t)])
    fixed = {(r.src, r.dst, r.lag) for r in causal.lagged_links(series(spark, x), 4, 4.0).collect()}
    searched = {(r.src, r.dst, r.lag) for r in causal.condition_set_links(series(spark, x), 4, 4.0).collect()}
    false = {("m1", "m2", 2), ("m3", "m5", 2)}
    assert false <= fixed and not false & searched
    assert searched == {("m0", "m1", 1), ("m0", "m2", 3), ("m3", "m4", 1), ("m4", "m5", 1)}


def test_links_of_short_and_missing_series(spark):
    short = series(spark, np.arange(12.0).reshape(2, 6) ** 2)
    assert causal.condition_set_links(short).count() >= 0
    assert causal.condition_set_links(short.limit(0)).isEmpty() and causal.lagged_links(short.limit(0)).isEmpty()


def test_a_large_incident_is_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    s = series(spark, rng.normal(size=(12, 30)).cumsum(axis=1))
    whole = rows(causal.lagged_links(s), "src", "dst", "lag"), rows(causal.condition_set_links(s), "src", "dst", "lag")
    monkeypatch.setattr(causal, "PAIR_BLOCK", 3)
    assert (rows(causal.lagged_links(s), "src", "dst", "lag"), rows(causal.condition_set_links(s), "src", "dst", "lag")) == whole


def dense_weights(x, edges, entry, rho):
    """Row-normalised walk matrix with partial weights, by least squares."""
    m = len(x)
    parents = {b: {a for a, c in edges if c == b} for b in range(m)}

    def weight(y):
        if y == entry:
            return 0.0
        cond = sorted((parents[entry] | parents[y]) - {entry, y})
        cond = sorted(cond, key=lambda c: (-abs(np.corrcoef(x[c], x[y])[0, 1]), c))[: max(1, min(x.shape[1] // 3, 5))]
        design = np.column_stack([*x[cond], np.ones(x.shape[1])])
        a, b = (v - design @ np.linalg.lstsq(design, v, rcond=None)[0] for v in (x[entry], x[y]))
        return abs(a @ b) / np.sqrt((a @ a) * (b @ b))

    w = [weight(y) for y in range(m)]
    q = np.zeros((m, m))
    for a, b in edges:
        q[b, a] = w[a]
        if (b, a) not in edges:
            q[a, b] = rho * w[b]
    for i in range(m):
        q[i, i] = max(0.0, w[i] - max((w[k] for k in parents[i]), default=0.0))
    total = q.sum(axis=1, keepdims=True)
    return np.divide(q, total, out=np.zeros_like(q), where=total > 0)


def test_partial_weights_of_many_metrics(spark):
    """150 metrics in one incident, nodes with more than five covariates among them."""
    rng = np.random.default_rng(21)
    m = 150
    x = rng.normal(size=(m, 30)).cumsum(axis=1)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, m, size=(600, 2)) if a != b}
    links = spark.createDataFrame([(1, f"m{a}", f"m{b}") for a, b in edges], "incident_id long, src string, dst string")
    entries = spark.createDataFrame([(1, "m7")], "incident_id long, entry string")
    got = np.zeros((m, m))
    for r in causal.transition(series(spark, x), links, entries).collect():
        got[int(r.src[1:]), int(r.dst[1:])] = r.p
    # ties of names aside, covariates are ordered by closeness, so the names' order does not matter
    assert np.abs(got - dense_weights(x, edges, 7, causal.BACKWARD)).max() < 1e-9


def test_visits_in_a_large_graph(spark):
    """A graph of 20,000 nodes, more than one task holds of it, with a node that a third of all arcs leave."""
    n = 20_000
    arcs = spark.range(n).selectExpr("id as src", "(id * 7 + 1) % 20000 as dst").union(spark.range(n).selectExpr("id as src", "(id * 3 + 5) % 20000 as dst"))
    arcs = arcs.union(spark.range(n).selectExpr("0L as src", "id as dst")).distinct()
    moves = arcs.join(arcs.groupBy("src").count(), "src").selectExpr("1L as incident_id", "string(src) as src", "string(dst) as dst", "1.0D / count as p")
    entries = spark.createDataFrame([(1, "0")], "incident_id long, entry string")
    got = causal.expected_visits(moves, entries, walks=1000, steps=7)
    src, dst, p = (np.array(x) for x in zip(*[(int(r.src), int(r.dst), r.p) for r in moves.collect()]))
    mass, want = np.zeros(n), np.zeros(n)
    mass[0] = 1000.0
    for _ in range(7):
        mass = np.bincount(dst, mass[src] * p, n)
        want += mass
    for r in got.collect():
        assert r.visits == pytest.approx(want[int(r.node)], rel=1e-9)
    assert got.count() == (want > 0).sum()


def test_service_walk_equals_dense_rounds(spark):
    rng = np.random.default_rng(4)
    names = ["front", *(f"s{i}" for i in range(8))]
    r = np.array([-1.0, *rng.uniform(0.05, 1, 8)])
    edges = {(0, 1), (0, 2), (1, 3), (1, 4), (2, 4), (4, 5), (5, 4), (3, 0), (6, 6), (4, 7)}
    a = np.zeros((9, 9))
    for i, j in edges:
        if i != j:
            a[i, j] = r[j]
            if i != 0 and (j, i) not in edges:
                a[j, i] = 0.5 * r[i]
    for i in range(1, 9):
        a[i, i] = max(0.0, r[i] - max((r[j] for k, j in edges if k == i and j != i), default=0.0))
    total = np.abs(a).sum(axis=1, keepdims=True)
    a = np.divide(a, total, out=np.zeros_like(a), where=total > 1e-9)
    x, v = np.zeros(9), np.where(np.arange(9) > 0, r, 0.0)
    for _ in range(50):
        x = 0.5 * a @ x + 0.5 * v
    corr = spark.createDataFrame([(1, names[i], float(r[i])) for i in range(1, 9)], "incident_id long, service string, r double")
    calls = spark.createDataFrame([(1, names[i], names[j]) for i, j in edges] + [(1, "other", "s1")], "incident_id long, src string, dst string")
    got = {row.service: row.score for row in causal.service_walk(calls, corr, "front").collect()}
    assert got == {name: pytest.approx(float(x[i]), abs=1e-9) for i, name in enumerate(names)}
