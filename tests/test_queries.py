"""The registry as a whole, and a cross-section of it against DuckDB at the smallest size."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
from tools.check_oracle import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")

SAMPLE = [
    "flagship_incident_service_deviation",
    "j2_normal_spans",
    "j8_truth_lookup",
    "g1_call_paths",
    "a14_trace_verdicts",
    "w7_point_window",
    "a18_step_scores",
    "w21_lagged_links",
    "r8_confidence_vote_fusion",
    "w10_s12_case_fields",
    "p14_error_log_excerpt",
    "f8_bleu4",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_sql_names_a_query_and_parses(con):
    names = contract.queries()
    for name, sql in contract.oracle_sql().items():
        assert name in names
        con.execute("EXPLAIN " + sql)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "rank" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, con, name):
    error, n = compare(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name])
    assert error is None, error


def test_localizers_share_one_schema(spark):
    from faultline.plans import plugins
    from faultline.sources.telemetry import Telemetry

    out = plugins.localize(Telemetry(spark, SF), ["anchor", "trace", "rrf", "fusion"])
    assert out.columns == plugins.RANKING
    assert {r[0] for r in out.select("source").distinct().collect()} == {"anchor", "trace", "rrf", "fusion"}
