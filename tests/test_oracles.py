"""Every registered query against its SQL statement on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differs

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    why, _ = differs(QUERIES[name](spark, SF), con, ORACLES[name])
    assert why is None, why


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert {"asset", "events", "status"} <= set(entry.entry(spark).columns)


NARROW = ["g01_hysteresis_events", "g03_event_lifecycle", "g03_event_lifecycle_rules", "g06_rules_in_force", "g07_rule_event_records", "g04_fault_boundary", "g05_order_points", "g08_persistence", "g09_confirm3", "g10_incidents_3x3", "g10_incidents_exact", "g15_fault_episodes", "g16_edge_trigger", "d01_gap", "d02_sequence_conflicts",
          "d03_accept_backfill", "d04_clock_drift", "d06_flag_late", "d07_make_sequences", "d10_history_reason", "d11_audit_sessions", "d12_offline_intervals", "a08_dependency_health", "c03_reject_overlaps", "j05_install_as_of", "n03_cooldown", "n03_cooldown_sent",
          "o07_phase_order", "l15_training_sequences", "l05_stratified_split"]


@pytest.mark.parametrize("name", NARROW)
def test_matches_sql_with_narrow_buckets(spark, con, name, monkeypatch):
    monkeypatch.setattr("tremolith.plans.scan.DAY_US", 10_000_000_000)
    monkeypatch.setattr("tremolith.plans.scan.POSITIONS", 7)
    why, _ = differs(QUERIES[name](spark, SF), con, ORACLES[name])
    assert why is None, why
