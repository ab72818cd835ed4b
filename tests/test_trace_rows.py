"""Traces worked on as one row against the round by round form, and what the plans read and move."""

import random
from types import SimpleNamespace

import pytest

from conftest import rows
from faultline.operators import causal, scale
from faultline.operators import spans as sp
from faultline.plans import traces
from faultline.sources.telemetry import Telemetry

SCHEMA = "trace_id long, span_id long, parent_span_id long, service string, duration double, status long, ts long"
SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    random.seed(5)
    data = []
    for trace in range(60):
        n = random.choice([1, 2, 5, 9])
        for i in range(1, n + 1):
            parent = random.choice([None, *range(1, n + 3)])  # roots, missing parents and cycles
            service = random.choice(["a", "b", "c", None])
            data.append((trace, i, parent, service, random.choice([0.5, 7.0, 30.0, None]), random.randrange(2), i))
    data += [(100, 1, None, "a", 1.0, 0, 1), (100, 1, None, "a", 2.0, 0, 2), (100, 2, 1, "b", 3.0, 0, 3)]  # an id met twice
    data += [(101, None, None, "a", 1.0, 0, 1), (101, 2, None, "b", 3.0, 1, 3), (None, 1, None, "a", 1.0, 0, 1)]
    return spark.createDataFrame(data, SCHEMA)


def test_rows_and_rounds_agree(mixed):
    assert rows(sp.call_paths(mixed)) == rows(sp.call_paths(mixed, row_spans=0))
    clean = mixed.filter("trace_id < 100")
    cols = sp.with_self_time(sp.call_paths(clean), clip=False).columns
    assert rows(sp.timed_paths(clean), *cols) == rows(sp.timed_paths(clean, row_spans=0), *cols)


@pytest.mark.parametrize("row_spans", [64, 3])
def test_marked_vectors(mixed, row_spans):
    clean = mixed.filter("trace_id < 100")
    got = sp.marked_vectors(clean, row_spans=row_spans)
    vectors = sp.stv(sp.call_paths(clean, row_spans=0))
    assert rows(got, "trace_id", "call_path", "rt") == rows(vectors)
    assert rows(sp.signatures(got)) == rows(sp.signatures(vectors), *sp.signatures(got).columns)
    cols = ["trace_id", "call_path", "rt", "n_match", "mean", "std"]
    split = lambda v, odd: v.filter(f"trace_id % 2 = {odd}")
    marked, plain = (sp.timeout_positions(split(v, 1), split(v, 0)) for v in (got, vectors))
    assert rows(marked, *cols) == rows(plain, *cols)


def test_short_traces_need_no_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(sp, "cut_lineage", lambda df: cuts.append(df) or df)
    sp.call_paths(spark.createDataFrame([(1, 1, None, "a", 1.0, 0, 1), (1, 2, 1, "b", 1.0, 0, 2)], SCHEMA)).collect()
    assert cuts == []


def test_profiles_are_not_replicated(spark, monkeypatch):
    monkeypatch.setattr(scale, "is_small", lambda *a: False)
    vectors = spark.createDataFrame([(i, "p", i) for i in range(8)], "trace_id long, call_path string, rt long")
    got = sp.timeout_positions(vectors.filter("trace_id < 2"), vectors.filter("trace_id >= 2"))
    assert "_salt" not in got._jdf.queryExecution().toString()
    assert {r.n_match for r in got.collect()} == {6}


def test_matches_are_not_held_by_the_driver(spark):
    span = lambda trace, i, parent, service, status: (trace, i, parent, service, 5.0, status, i)
    data = [span(t, 1, None, "a", int(t < 3)) for t in range(11)] + [span(2, 2, 1, "b", 0), span(20, 1, None, "z", 1)]
    found = traces.j12_match(SimpleNamespace(spans=spark.createDataFrame(data, SCHEMA)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan and "InMemoryRelation" not in plan and "_salt" not in plan
    assert rows(found) == sorted([(t, 2 + pos, pos) for t in (0, 1) for pos in range(1, 7)], key=str)


def test_verdicts_take_all_normals_of_a_signature(spark):
    normal = [(10 + i, 1, None, "a", ms, 0, i) for i, ms in enumerate([10.0, 11.0, 12.0, 10.0, 11.0, 12.0, 100.0, 120.0])]
    bad = [(1, 1, None, "a", 50.0, 1, 0), (2, 1, None, "a", 5000.0, 1, 0), (3, 1, None, "z", 9.0, 1, 0)]
    found = traces.a14_verdicts(SimpleNamespace(spans=spark.createDataFrame(normal + bad, SCHEMA)))
    got = {r.trace_id: (r.n_match, r.n_out, r.verdict) for r in found.collect()}
    # against the first six alone 50 ms would be a timeout
    assert got == {1: (8, 0, "none"), 2: (8, 1, "timeout"), 3: (0, 0, "structural")}


def test_tasks_hold_a_fixed_number_of_reports(spark):
    many = scale.spread(spark.range(10_000), 10_000, ["id"], task_rows=100)
    assert many.rdd.getNumPartitions() == 100
    plan = Telemetry(spark, SMOKE).spans._jdf.queryExecution().sparkPlan().toString()
    # merged only after they are dealt out, so that no map of a whole file split is held
    assert plan.index("HashAggregate") < plan.index("Exchange")
    assert "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM"):]


def test_correlation_reads_its_rows_once(spark, tmp_path):
    data = [(1, t, s, float((t * 7 + len(s)) % 5)) for t in range(6) for s in ("svc0", "svc11", "x") if (t, s) != (3, "x")]
    data.append((2, 1, "x", 1.0))  # without the entry service
    spark.createDataFrame(data, "incident_id long, trace_id long, service string, self_time double").write.parquet(f"{tmp_path}/p")
    got = causal.service_correlation(spark.read.parquet(f"{tmp_path}/p"), "svc0")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert {(r.incident_id, r.service) for r in got.collect()} == {(1, "svc11"), (1, "x")}
