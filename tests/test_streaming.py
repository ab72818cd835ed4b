import datetime as dt

import numpy as np
import pytest

from faultline.operators.detect import tail_limits
from faultline.streaming import live

T0 = dt.datetime(2024, 1, 1)


def stream(spark, path, df, schema):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_late_rows_and_open_windows(spark, tmp_path):
    schema = "ts timestamp, service string, kpi string, value double"
    data = [(T0 + dt.timedelta(seconds=s), "a", "cpu", float(s)) for s in (1, 2, 31, 200)]
    rows = stream(spark, str(tmp_path / "in"), spark.createDataFrame(data, schema), schema)
    out = spark.read.parquet(live.run_available(live.bucketed(rows, "1 minute"), "test"))
    got = {r.ts: (r.value, r.n) for r in out.collect()}
    # the window of the last row is still open
    assert got == {T0: (1.5, 2), T0 + dt.timedelta(seconds=30): (31.0, 1)}


def test_live_thresholds_equal_the_batch_form(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = rng.normal(10, 1, 80)
    v[60] = 90
    schema = "ts timestamp, service string, kpi string, value double"
    data = [(T0 + dt.timedelta(hours=i), "a", "cpu", float(x)) for i, x in enumerate(v)]
    rows = stream(spark, str(tmp_path / "in"), spark.createDataFrame(data, schema), schema)
    out = spark.read.parquet(live.run_available(live.live_thresholds(rows), "test")).orderBy("ts").collect()
    ups, _, alarms = tail_limits(v, 30, 1e-3, 10, False)
    assert [r.threshold for r in out] == pytest.approx(ups)
    assert [r.alarm for r in out] == alarms and out[30].alarm


def test_state_survives_several_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, 70)
    schema = "ts timestamp, service string, kpi string, value double"
    for b in range(2):
        part = [(T0 + dt.timedelta(hours=i), "a", "cpu", float(v[i])) for i in range(35 * b, 35 * b + 35)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = spark.read.parquet(live.run_available(live.live_thresholds(rows), "test")).orderBy("ts").collect()
    ups, _, _ = tail_limits(v, 30, 1e-3, 10, False)
    assert [r.threshold for r in out] == pytest.approx(ups)


def test_pairs_of_spans_and_faults_are_not_shuffled(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    reports = [(at(s % 900), 1 + s // 2, s % 2, f"svc{s % 3}") for s in range(1500)] + [(at(100), 51, 0, "svc1")] * 2
    found = [(at(40 * k + 0.5 * (k % 2)), k, f"svc{k % 2}") for k in range(30)] + [(at(360), 0, "svc1"), (at(3600), 40, "svc0")]
    spans = spark.createDataFrame(reports, "ts timestamp, trace_id long, span_id long, service string")
    half = dt.timedelta(seconds=180)
    for extra in ([], [(at(7), None, "svc0"), (at(9), None, "svc0")]):
        faults = spark.createDataFrame([f for f in found if extra or f[1] != 0] + extra, "fault_ts timestamp, event_id long, service string")
        path = tmp_path / str(len(extra))
        left = stream(spark, str(path / "spans"), spans, spans.schema)
        right = stream(spark, str(path / "faults"), faults, faults.schema)
        slots = spark.read.parquet(live.run_available(live.fault_slots(left, right, "10 minutes"), "test"))
        want, moments = {}, faults.collect()
        for ts, trace, span, service in reports:
            for fault_ts, event, name in moments:
                if service == name and fault_ts - half <= ts < fault_ts + half:
                    want[event, trace, span] = want.get((event, trace, span), 0) + 1
        pairs = live.span_faults(spans, faults, slots)
        assert {tuple(r)[:3]: r.n for r in pairs.collect()} == want and pairs.count() == len(want)
        assert slots.count() <= 2 * faults.count()
        if not extra:
            plan = pairs._jdf.queryExecution().optimizedPlan().toString()
            assert not plan.startswith("Aggregate")
