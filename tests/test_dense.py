"""Many samples at one time and many spans over one another: counted, not laid out in pairs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pulseframe.operators import intervals
from pulseframe.plans import recovery

T0 = dt.datetime(2024, 1, 1, 20)


def moment(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_how_many_spans_hold_a_point(spark):
    draw = random.Random(4)
    spans = [(draw.choice([1, 2]), a := draw.randrange(400), a + draw.choice([0, 5, 90])) for _ in range(50)]
    points = [(draw.choice([1, 2, 3]), draw.randrange(450)) for _ in range(90)]
    wide = spark.createDataFrame([(k, moment(a), moment(b)) for k, a, b in spans], "k int, a timestamp, b timestamp")
    dots = spark.createDataFrame([(k, moment(t)) for k, t in points], "k int, at timestamp")
    got = sorted((r.k, r["at"], r["_times"]) for r in intervals.covering(dots, wide, ["k"], "at", "a", "b", F.date_trunc("hour", "at")).collect())
    times = [(k, moment(t), sum(k == k2 and a <= t < b for k2, a, b in spans)) for k, t in points]
    assert got == sorted(r for r in times if r[2])


def test_a_crowded_night_has_the_rate_of_one_by_one(spark, monkeypatch):
    draw = random.Random(7)
    sleep = spark.createDataFrame([(1, moment(a := draw.randrange(300)), moment(a + draw.randrange(1, 200)), draw.choice(["core", "rem", "asleep"])) for _ in range(20)], "k int, start_ts timestamp, end_ts timestamp, stage string")
    readings = spark.createDataFrame([(1, moment(draw.randrange(500)), "heart_rate", draw.choice([None, 50.0, 61.5, 72.25])) for _ in range(120)], "k int, start_ts timestamp, type string, value double")
    rows = lambda: recovery.sleeping_rate(sleep, readings, ["k"], 60, least_hours=0.5).drop("asleep_hours").collect()
    single = rows()
    monkeypatch.setattr(recovery, "NIGHT_ROWS", 0)
    counted = rows()
    assert len(single) == 1 and single[0].valid_windows == counted[0].valid_windows > 5 and abs(single[0].value - counted[0].value) < 1e-9


def test_zones_and_splits_of_equal_spans(spark):
    from pulseframe.operators import zones
    from pulseframe.plans.tools import workout_details

    draw = random.Random(9)
    records = spark.createDataFrame(
        [(1, i, draw.choice(["heart_rate", "distance_walking_running"]), T0 + dt.timedelta(seconds=20 * draw.randrange(90)), draw.choice([0.25, 120.0, 160.0, None])) for i in range(200)], "subject_id int, row_hash int, type string, start_ts timestamp, value double"
    )
    chosen = spark.createDataFrame([(1, n, moment(a), moment(b)) for n, (a, b) in enumerate([(0, 12), (0, 12), (5, 5), (7, 40), (50, 60)])], "subject_id int, row_hash int, start_ts timestamp, end_ts timestamp")
    told = workout_details(chosen, records, records, include="zones splits")
    spans = chosen.select("subject_id", F.col("row_hash").alias("workout"), F.col("start_ts").alias("ws"), F.col("end_ts").alias("we"))
    inside = intervals.points_in(records, spans, ["subject_id"], "start_ts", "ws", "we", True)
    models = {"percent": zones.tr.percent_bounds(190.0), "training": zones.tr.named_bounds(None)}
    plain = zones.time_in_zones(inside.filter("type = 'heart_rate'"), ["workout"], models)
    assert sorted(map(tuple, told["zones"].collect())) == sorted(map(tuple, plain.collect()))
    splits = {n: sorted(tuple(r)[1:] for r in told["splits"].filter(F.col("workout") == n).collect()) for n in (0, 1)}
    assert splits[0] and splits[0] == splits[1]
    for part in ("zones", "splits"):  # no window over one workout's samples
        assert "windowspecdefinition(workout" not in told[part]._jdf.queryExecution().toString()


def test_a_nights_samples_are_read_once_and_not_shuffled_to_it(spark, tmp_path):
    sleep = spark.createDataFrame([(1, moment(0), moment(300), "core"), (1, moment(1500), moment(1900), "asleep"), (1, moment(1440), moment(1950), "in_bed")], "k int, start_ts timestamp, end_ts timestamp, stage string")
    spark.createDataFrame([(1, moment(n * 5), kind, 50.0 + n % 40) for n in range(400) for kind in ("heart_rate", "hrv")], "k int, start_ts timestamp, type string, value double").write.parquet(f"{tmp_path}/readings")
    readings = spark.read.parquet(f"{tmp_path}/readings")
    told = recovery.night_inputs(sleep, readings, ["k"])
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("type:string,value:double") == 2
    assert plan.count("BroadcastHashJoin [k") >= 2
    alone = recovery.sleeping_rate(sleep, readings, ["k"], least_hours=0.5)
    assert alone._jdf.queryExecution().executedPlan().toString().count("value:double") == 1
    rows = {r.night.day: (r.value, r.source, r.valid_windows) for r in alone.collect()}
    second = sorted(50.0 + n % 40 for n in range(300, 380))
    low = second[3] + 0.95 * (second[4] - second[3])  # at rank 0.05 * 79
    assert rows[2] == (50.5, "stage_restricted", 59) and rows[3][1:] == ("p5_fallback", None) and abs(rows[3][0] - low) < 1e-9
