"""Physical plans: one shuffle and one sort per timeline, pruned scans, early top-n cuts."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from axlewatch.operators import segments
from axlewatch.operators.segments import sized_broadcast
from axlewatch.plans import adapt

SF = "/root/testdata/sf0.01"


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def count(text, node):
    return len(re.findall(rf"\b{node}\b(?!QueryStage)", text))


def query_plan(spark, name):
    return plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", [
    "hysteresis", "dwell_seconds", "alarm_events", "sliding_sequences", "rolling_window_state",
    "fit_val_split", "acceleration", "brake_activity"])
def test_a_timeline_is_shuffled_and_sorted_once(spark, name):
    text = query_plan(spark, name)
    assert count(text, "Exchange") == 1, text
    assert count(text, "Sort") == 1, text
    assert count(text, "FileScan") == 1


@pytest.mark.parametrize("name,column", [
    ("hysteresis", "value"), ("confusion_matrix", "ts"), ("axle_line_map", "value"), ("label_codes", "text"),
    ("dominant_value", "o_totalprice")])
def test_scans_read_only_what_they_need(spark, name, column, monkeypatch):
    # a checkpoint would hide the scan below a ranking
    monkeypatch.setattr(segments, "checkpointed", lambda df: df)
    text = query_plan(spark, name)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and not any(re.search(rf"\b{column}:", s) for s in schemas), schemas


def test_filters_reach_the_scan(spark):
    text = plan(adapt.telemetry(spark, SF).where("sample_id > 9900").select("sample_id"))
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,9900)" in text


@pytest.mark.parametrize("name", ["top_alarms_per_tick", "recent_series"])
def test_ranked_groups_are_cut_before_they_are_collected(spark, name):
    assert "WindowGroupLimit" in query_plan(spark, name)


@pytest.mark.parametrize("name", ["recent_events", "last_alarms", "top_anomalies", "alarms_by_axle"])
def test_limits_sort_no_whole_table(spark, name):
    assert "TakeOrderedAndProject" in query_plan(spark, name)


def test_no_query_crosses_tables(spark):
    for name in ("bbox_intersects", "chronological_split", "line_share", "class_weights", "locate_on_line"):
        text = query_plan(spark, name)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_python_stays_out_of_batch_queries(spark):
    for name in ("alarms_by_axle", "window_vectors", "episode_label_join", "running_metrics"):
        assert "Python" not in query_plan(spark, name)
        assert "InPandas" not in query_plan(spark, name)


def test_carries_join_without_a_second_shuffle_of_the_rows(spark, small_segments):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        text = query_plan(spark, "dwell_seconds")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    joins = count(text, "SortMergeJoin")
    assert joins == 2
    # one exchange of the rows, and one per (small) carry table
    assert count(text, "Exchange") == 1 + joins, text


def test_large_dimensions_are_not_broadcast(spark):
    dim = spark.range(100).select(F.col("id").alias("k"), F.array(F.lit(1), F.lit(2)).alias("xs"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sized_broadcast(dim, limit=100))
    assert not hinted(sized_broadcast(dim, limit=99))
    assert not hinted(sized_broadcast(dim, F.size("xs"), limit=199))


@pytest.mark.parametrize("name", ["nearest_defect", "locate_on_line", "episode_label_join", "defect_zone_join"])
def test_results_are_the_same_beyond_the_broadcast_limit(spark, name):
    build = entry.queries()[name]
    rows = lambda: sorted(map(str, build(spark, "/root/testdata/sf0.001").collect()))
    small = rows()
    spark.conf.set("axlewatch.broadcast.rows", "1")
    try:
        assert rows() == small
    finally:
        spark.conf.unset("axlewatch.broadcast.rows")
