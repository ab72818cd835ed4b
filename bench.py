"""Headline queries, timed one after the other; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from faultline.plans import catalog
from faultline.session import build_session

HEADLINE = [
    "flagship_incident_service_deviation",
    "j1_fault_window_spans",
    "j2_normal_spans",
    "j3_wide_window_spans",
    "j6_parent_links",
    "g1_call_paths",
    "a3_service_self_time",
    "a6_spectrum",
    "a7_service_trace_features",
    "a14_trace_verdicts",
    "w7_point_window",
    "w15_deviation_severity",
    "a18_step_scores",
    "w18_tail_threshold_drift",
    "w21_lagged_links",
    "g4_walk_visits",
    "r8_confidence_vote_fusion",
    "r16_parameter_sweep",
    "a35_paired_bootstrap",
    "f8_bleu4",
    "j17_f11_events_to_nodes",
    "w10_s12_case_fields",
    "full_incident_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
