"""Every named query against its SQL counterpart, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as driver
from compare import differences, duck
from trafficlens.plans.oracle import ORACLE
from trafficlens.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
QUERIES = REGISTRY


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_result_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) is None


def test_flagship_has_rows(spark):
    assert driver.entry(spark).count() > 0


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


# Queries whose branches must share one scan of the log instead of reading it again.
ONE_SCAN = [
    "period_stats", "dimension_counts", "top10_per_dimension", "period_report", "multi_period_stats",
    "byte_alarm", "anchored_periods", "traffic_state", "traffic_crossings", "traffic_crossings_by_method",
    "second_extent", "period_totals_densified",
]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_log_is_scanned_once(spark, name):
    assert len(re.findall("FileScan", final_plan(QUERIES[name](spark, SF_DIR)))) == 1


@pytest.mark.parametrize("name", ["interval_fetch", "start_position"])
def test_time_bounds_reach_the_scan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan)


def test_scans_read_only_what_is_needed(spark):
    plan = QUERIES["hits_per_second"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz>", plan)


# Of the live job's results the plan is that of reading its tables; running it again for that takes long.
LIVE = {"stream_job", "stream_anchored_stats", "stream_flushed", "stream_late_rows", "stream_custom_period"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"custom_period_pandas", "anchored_periods", "anchored_rows"} - LIVE))
def test_no_python_and_no_cross_join_in_the_plan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_lists_are_cut_before_the_shuffle(spark):
    plan = QUERIES["top10_per_dimension"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)
