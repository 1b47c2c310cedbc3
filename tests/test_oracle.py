"""Registered queries against their SQL at the smallest scale.

``compare.py`` runs all of them at any scale; this takes one of each family.
"""

import pytest
from compare import compare, connection

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "s1_x6_scan_plain",
    "s4_x1_scan_jsonl",
    "s9_parse_events",
    "s13_a14_codehost_deployments",
    "s16_explode_alerts",
    "s17_j1_j2_ingest_outcomes",
    "x8_x10_message_pattern",
    "x12_event_fingerprint",
    "x31_redact_documents",
    "a1_error_groups",
    "a5_merge_incidents",
    "a16_aggregate_scores",
    "w1_w2_w3_w4_rolling_stats",
    "w8_markers",
    "j5_x23_x24_u1_u3_entries",
    "j7_correlate_temporal",
    "p4_j17_graph_edges",
    "t3_stream_error_groups",
)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streamed_alerts_equal_batch(spark):
    def rows(name):
        return sorted(tuple(r) for r in entry.queries()[name](spark, SF).select("project_id", "seq", "action").collect())

    assert rows("t4_stream_incidents") == rows("j14_apply_alerts")


def test_streamed_anomalies_equal_batch(spark):
    streamed = {(r["metric_name"], r["id"], s) for r in entry.queries()["t5_stream_anomalies"](spark, SF).collect() for s in r["signals"].split(",")}
    batch = {(r["metric_name"], r["id"], r["signal_type"]) for r in entry.queries()["w5_detect_anomalies"](spark, SF).collect()}
    # A rank or z-score on a threshold may fall on either side of it by one rounding.
    assert len(streamed ^ batch) <= 2
