"""Every registered query against its SQL form, also with series cut into short segments."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())
CUT = ["hysteresis", "dwell_seconds", "alarm_events", "sliding_sequences", "fit_val_split",
       "rolling_window_state", "acceleration", "brake_activity", "alarm_duration", "window_vectors"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    problems, *_ = compare(spark, con, name, entry.queries()[name], sql, SF)
    assert not problems, problems


@pytest.mark.parametrize("name", CUT)
def test_query_in_segments(spark, con, small_segments, name):
    problems, *_ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems, problems


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["axle", "line_id", "alarm_count", "severe_count", "avg_prior_s", "last_alarm"]
    assert df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
