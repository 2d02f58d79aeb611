"""The interval index and the joins on it, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from axlewatch.operators import joins as J
from axlewatch.operators.alarms import nearest_defect

DEFECTS = "line_id string, defect_id string, km double, width_km double, between_text string, ord long"


def test_an_interval_lies_in_at_most_two_buckets_whatever_its_length(spark):
    rng = random.Random(4)
    rows = [("k", float(rng.randrange(10**7)) / 7, 10 ** rng.uniform(0, 6), i) for i in range(3000)]
    rows += [("k", 8.0 * i, 8.0, 10_000 + i) for i in range(100)] + [("k", 5.0, 0.0, 20_000)]
    table = spark.createDataFrame(rows, "k string, low double, length double, i long")
    index = J.IntervalIndex(table, "k", F.col("low"), F.col("low") + F.col("length"), F.struct("i", "low", "length"))
    per = index.table.select(F.explode("_items").alias("x")).groupBy("x.i").count()
    assert per.agg(F.max("count")).first()[0] <= 2 and per.count() == len(rows)
    # each interval is found at its ends and inside, and only intervals around a point are met
    points = [(r[3], "k", r[1] + share * r[2]) for r in rows[::7] for share in (0.0, 0.3, 1.0)]
    met = index.attach(spark.createDataFrame(points, "want long, k string, at double"), F.col("at"), "met")
    for r in met.collect():
        items = {x["i"]: x for x in r["met"]}
        assert r["want"] in items
        assert {i for i, x in items.items() if x["low"] <= r["at"] <= x["low"] + x["length"]} == {
            i for _, low, length, i in rows if low <= r["at"] <= low + length}


def plain_nearest(defects, line, km):
    near = min(((abs(d[2] - km), d[5], d) for d in defects if d[0] == line), default=None)
    return near[2][1] if near and near[0] <= near[2][3] + 0.8 else None


@pytest.mark.parametrize("block", [4096, 5])
def test_nearest_defect_among_many(spark, block, monkeypatch):
    """Ties, several defects at one place, wide ones over narrow ones; lines cut into stretches too."""
    from axlewatch.operators import alarms
    whole = alarms.defect_reaches
    monkeypatch.setattr(alarms, "defect_reaches", lambda d, slack: whole(d, slack, block))
    rng = random.Random(block)
    defects = [(f"L{i % 3}", f"d{i}", rng.randrange(200) / 4, rng.choice([0.01, 0.2, 1.0, 30.0]), "t", i * 7 % 120 + 10) for i in range(120)]
    defects += [("L1", "wide", 10.0, 500.0, "t", 5), ("L9", "alone", 1.0, 0.1, "t", 1)]
    rows = [(i, f"L{i % 4}", rng.randrange(480) / 8) for i in range(800)] + [(900, "L9", 1.9), (901, "L9", 1.91), (902, None, 1.0), (903, "L1", None)]
    got = nearest_defect(spark.createDataFrame(rows, "i long, line_id string, track_km double"), spark.createDataFrame(defects, DEFECTS))
    found = {r["i"]: r["defect_id"] for r in got.collect()}
    assert len(found) == len(rows)
    for i, line, km in rows:
        want = plain_nearest(defects, line, km) if km is not None else None
        assert found[i] == want, (i, line, km, want)


def test_joins_without_any_interval(spark):
    none = spark.createDataFrame([], DEFECTS)
    rows = spark.createDataFrame([(1, "L1", 2.0)], "i long, line_id string, track_km double")
    assert nearest_defect(rows, none).first()["defect_id"] is None


EPISODES = "axle_key string, ord long, start_step long, len_steps long, fault_type string"


def plain_cover(episodes, axle, step):
    return min((e[1:] for e in episodes if e[0] == axle and e[2] <= step < e[2] + e[3]), default=None)


@pytest.mark.parametrize("limit", ["200000", "1"])
def test_episodes_of_any_length_in_blocks(spark, limit):
    """Short and long episodes over sparse steps on both sides of zero; equal places in the list; broadcast or not."""
    rng = random.Random(3)
    episodes = [(f"a{i % 3}", rng.randrange(150), rng.randrange(-400, 40_000), 2 ** rng.randrange(21), rng.choice("xyz")) for i in range(300)]
    episodes += [("a0", 200 + i, 5 - i, 1 << 40, "w") for i in range(3)] + [("a1", 1, 7, 0, "never"), (None, 0, 0, 10, "x"), ("a1", 0, None, 3, "x")]
    steps = [*range(-300, 300, 3), *(rng.randrange(3_000_000) for _ in range(300))]
    rows = [(i, f"a{i % 4}", s) for i, s in enumerate(steps)] + [(9000, None, 3), (9001, "a1", None)]
    spark.conf.set("axlewatch.broadcast.rows", limit)
    try:
        got = {r["i"]: r for r in J.episode_label_join(
            spark.createDataFrame(rows, "i long, axle_key string, seq long"), spark.createDataFrame(episodes, EPISODES), keep=True).collect()}
    finally:
        spark.conf.unset("axlewatch.broadcast.rows")
    assert len(got) == len(rows)
    sound = [e for e in episodes if e[0] and e[2] is not None]
    for i, axle, step in rows:
        want = plain_cover(sound, axle, step) if axle and step is not None else None
        assert (got[i]["start_step"], got[i]["len_steps"]) == (want[1:3] if want else (None, None)), (i, axle, step)


def test_long_episodes_add_no_shuffle_of_the_rows(spark):
    """Rows meet one list per level of 128, whatever the lengths; a list holds what can cover a step first."""
    episodes = spark.range(20_000).select(
        F.lit("a").alias("axle_key"), (F.col("id") * 7919 % 20_011).alias("ord"), (F.col("id") % 60).alias("start_step"),
        F.pow(F.lit(2.0), F.col("id") % 21).cast("long").alias("len_steps"), F.lit("x").alias("fault_type"))
    rows = spark.range(100).select(F.lit("a").alias("axle_key"), F.col("id").alias("seq"))
    out = J.episode_label_join(rows, episodes, keep=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    index = J.FirstCover(episodes, "axle_key", F.col("start_step"), F.col("start_step") + F.col("len_steps") - 1, F.struct("ord"), 0, 99)
    assert index.table.agg(F.max(F.size("_items"))).first()[0] < 128
    plain = [tuple(r) for r in episodes.collect()]
    for r in out.collect():
        assert (r["start_step"], r["len_steps"]) == plain_cover(plain, "a", r["seq"])[1:3]


def test_episodes_of_no_rows_and_rows_of_no_episodes(spark):
    rows, none = spark.createDataFrame([("a", 3)], "axle_key string, seq long"), spark.createDataFrame([], EPISODES)
    assert J.episode_label_join(rows, none).first()["episode_label"] == "normal"
    one = spark.createDataFrame([("a", 1, 0, 10, "x")], EPISODES)
    assert J.episode_label_join(rows.where("seq > 3"), one).count() == 0
