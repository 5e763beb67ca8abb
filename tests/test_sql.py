"""Every registered query with a statement, on the smallest tables."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from check_sql import compare

# Queries whose ordered steps are sliced when keys are hot.
ORDERED = [
    "asof_last_touch", "campaign_performance_daily", "marketing_attribution_gold", "running_balance", "stockout_crossings", "end_of_day_snapshot",
    "inventory_position_current", "sessionize_gap", "ordered_path", "dwell_by_lead", "zone_dwell_stats", "path_metrics", "prior_history_join",
    "percentile_stats", "sample_exact_rate", "returns_reverse", "promotion_lift", "rfm_segments", "pricing_decision_time", "dwell_features",
]


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_equals_statement(spark, duck, key):
    assert compare(spark, duck, key, SF).startswith("ok")


@pytest.mark.parametrize("key", ORDERED)
def test_sliced_plan_equals_statement(spark, duck, hot_keys, key):
    assert compare(spark, duck, key, SF).startswith("ok")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
