"""Trace operators on the edge rows the inputs are known to hold."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from faultline.functions import projections as pj
from faultline.operators import spans as sp

SCHEMA = "trace_id long, span_id long, parent_span_id long, service string, duration double, status long, ts long"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def spans(spark):
    return frame(
        spark,
        [
            (1, 1, None, "a", 100.0, 0, 10),
            (1, 2, 1, "b", 30.0, 0, 11),
            (1, 3, 1, "c", 120.0, 1, 12),
            (1, 4, 2, "a", 5.0, 0, 13),
            (2, 1, None, "a", 50.0, 0, 20),  # two spans without parent
            (2, 2, None, "b", 60.0, 0, 25),
            (3, 5, 9, "c", 10.0, 0, 30),  # parent is missing, no root
            (3, 6, 5, "a", 4.0, 0, 31),
        ],
    )


def test_links(spans):
    got = {(r.trace_id, r.span_id): r.link for r in sp.with_parent(spans).collect()}
    assert got[(1, 1)] == "root" and got[(1, 4)] == "child" and got[(3, 5)] == "orphan"


def test_self_time(spans):
    got = {(r.trace_id, r.span_id): (r.n_children, r.self_time) for r in sp.with_self_time(spans).collect()}
    assert got == {
        (1, 1): (2, 0.0), (1, 2): (1, 25.0), (1, 3): (0, 120.0), (1, 4): (0, 5.0),
        (2, 1): (0, 50.0), (2, 2): (0, 60.0), (3, 5): (1, 6.0), (3, 6): (0, 4.0),
    }
    raw = {(r.trace_id, r.span_id): r.self_time for r in sp.with_self_time(spans, clip=False).collect()}
    assert raw[(1, 1)] == -20.0


def test_roots(spans):
    got = rows(sp.trace_summary(spans), "trace_id", "root_span_id", "span_count")
    assert got == [(1, 1, 4), (2, 2, 2), (3, 5, 2)]
    assert rows(sp.trace_summary(spans, False), "trace_id", "root_span_id")[2] == (3, None)


def test_call_paths(spans):
    got = {(r.trace_id, r.span_id): (r.call_path, r.depth) for r in sp.call_paths(spans).collect()}
    assert got[(1, 4)] == ("start#a#b#a", 3)
    assert got[(1, 3)] == ("start#a#c", 2)
    assert got[(3, 5)] == ("unclear_start#c", 1)
    assert got[(3, 6)] == ("unclear_start#c#a", 2)


def test_long_chain_and_cycle(spark):
    chain = [(1, i, i - 1 if i > 1 else None, f"s{i}", 1.0, 0, i) for i in range(1, 41)]
    got = {r.span_id: r for r in sp.call_paths(frame(spark, chain)).collect()}
    assert got[40].depth == 40
    assert got[40].call_path == "start#" + "#".join(f"s{i}" for i in range(1, 41))


def test_cycles_are_marked_and_other_traces_complete(spark):
    loop = [(1, 1, 2, "a", 1.0, 0, 1), (1, 2, 3, "b", 1.0, 0, 2), (1, 3, 1, "c", 1.0, 0, 3)]
    under = [(1, 4, 3, "d", 1.0, 0, 4), (1, 5, 4, "e", 1.0, 0, 5), (1, 6, 6, "f", 1.0, 0, 6)]
    beside = [(1, 7, None, "a", 1.0, 0, 7), (1, 8, 7, "b", 1.0, 0, 8)]
    others = [(2, 1, None, "a", 1.0, 0, 1), (2, 2, 1, "b", 1.0, 0, 2), (3, 1, 1, "x", 1.0, 0, 1)]
    got = {(r.trace_id, r.span_id): (r.call_path, r.depth) for r in sp.call_paths(frame(spark, loop + under + beside + others)).collect()}
    assert got == {
        (1, 1): ("cyclic#a", None), (1, 2): ("cyclic#b", None), (1, 3): ("cyclic#c", None), (1, 4): ("cyclic#d", None),
        (1, 5): ("cyclic#e", None), (1, 6): ("cyclic#f", None), (1, 7): ("start#a", 1), (1, 8): ("start#a#b", 2),
        (2, 1): ("start#a", 1), (2, 2): ("start#a#b", 2), (3, 1): ("cyclic#x", None),
    }


def test_a_parent_with_very_many_children(spark):
    many = spark.range(30_000).selectExpr("1L as trace_id", "id + 2 as span_id", "1L as parent_span_id", "'c' as service", "1.0D as duration", "0L as status", "id as ts")
    spans = many.union(frame(spark, [(1, 1, None, "a", 1.0, 0, 0), (1, 50_000, 7, "d", 1.0, 0, 9)]))
    got = sp.call_paths(spans)
    assert got.count() == 30_002 and got.filter("call_path = 'start#a#c'").count() == 30_000
    assert got.filter("span_id = 50000").first().call_path == "start#a#c#d"


def vectors(spark, data):
    return spark.createDataFrame(data, "trace_id long, call_path string, rt long")


def test_signature_match_none_one_seven(spark):
    normal = [(10, "p", 5)] + [(20 + i, p, 10 + i) for i in range(7) for p in ("p", "q")]
    bad = [(1, "z", 9), (2, "p", 50), (3, "p", 500), (3, "q", 12), (4, "p", 13), (4, "q", 12), (4, "w", 0)]
    pos = sp.timeout_positions(vectors(spark, bad), vectors(spark, normal))
    at = {(r.trace_id, r.call_path): r for r in pos.collect()}
    assert at[(1, "z")].n_match is None
    assert at[(2, "p")].n_match == 1 and at[(2, "p")].std is None and not at[(2, "p")].out
    # only the first six of seven normals count
    assert at[(3, "p")].n_match == 6 and at[(3, "p")].mean == 12.5 and at[(3, "p")].out
    std = math.sqrt(sum((x - 12.5) ** 2 for x in range(10, 16)) / 5)
    assert at[(3, "p")].score == pytest.approx((500 - 12.5) / std / 3)
    verdicts = {r.trace_id: r.verdict for r in sp.trace_verdicts(pos).collect()}
    assert verdicts == {1: "structural", 2: "none", 3: "timeout", 4: "none"}


def test_spectrum(spark):
    traces = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "trace_id long, failed int")
    visited = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (1, "b")], "trace_id long, service string")
    got = {r.service: r.ochiai for r in sp.spectrum(traces, visited).collect()}
    assert got["a"] == pytest.approx(2 / math.sqrt((2 + 1) * (2 + 0.0001)))
    assert got["b"] == pytest.approx(1 / math.sqrt((1 + 0.0001) * (1 + 1)))


def test_row_order_does_not_matter(spans):
    shuffled = spans.orderBy(F.rand(3)).repartition(5)
    assert rows(sp.call_paths(shuffled), "span_id", "call_path") == rows(sp.call_paths(spans), "span_id", "call_path")
    assert rows(sp.trace_summary(shuffled)) == rows(sp.trace_summary(spans))


def test_field_projections(spark):
    df = spark.createDataFrame([("OK",), ("Ok",), ("200",), ("0",), ("500",), ("",), ("x",)], "s string")
    assert [r[0] for r in df.select(pj.status_code(F.col("s"))).collect()] == [0, 0, 0, 0, 500, 0, 0]
    times = spark.createDataFrame(
        [("2021-07-01 10:00:00", "2021-07-01 10:00:01.250"), ("2021-07-01 10:00:00.5", "bad")], "a string, b string"
    )
    assert [r[0] for r in times.select(pj.duration_ms(F.col("a"), F.col("b"))).collect()] == [1250.0, None]
    ids = spark.createDataFrame([("",), ("nan",), ("0",), ("x1",)], "p string")
    assert [r[0] for r in ids.select(pj.parent_id(F.col("p"))).collect()] == [None, None, None, "x1"]
    text = spark.createDataFrame(
        [("at 2021/07/01 11:16 and 2021/7/2 1:05", "x"), ("at 2021-07-01 11:16", "y"), ("none", "z")], "t string, k string"
    )
    got = [r[0] for r in text.select(pj.dates_to_epoch(F.col("t"))).collect()]
    assert got == ["at 1625138160 and 1625187900", "at 1625138160", "none"]
    names = spark.createDataFrame([("cluster-1",), ("cluster-2",), ("cluster",)], "c string")
    assert [r[0] for r in names.select(pj.directory_prefix(F.lit("0320"), F.col("c"))).collect()] == ["0320", "0320b", "0320t"]
