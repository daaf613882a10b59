"""Splits of many spans over one another: by stretches of time, not by a window over all pairs."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from pulseframe.operators import intervals, workouts
from pulseframe.plans.tools import workout_details

T0 = dt.datetime(2024, 1, 1, 20)


def moment(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def drawn(spark):
    draw = random.Random(11)
    at = {(draw.choice([1, 2, None]), draw.randrange(-30, 3000)) for _ in range(1800)}
    samples = spark.createDataFrame([(k, moment(t), draw.choice([None, 0.0, 0.25, 0.25, 1.75, 30.0, -0.5])) for k, t in sorted(at, key=repr)], "k int, start_ts timestamp, value double")
    starts = [(draw.choice([1, 2, 3, None]), draw.randrange(2500), draw.choice([-5, 0, 20, 60, 61, 240, 700])) for _ in range(80)]
    spans = spark.createDataFrame([(k, f"w{n}", moment(a), moment(a + length)) for n, (k, a, length) in enumerate(starts)], "k int, name string, ws timestamp, we timestamp")
    return samples, spans


def told(df):
    return sorted(map(tuple, df.collect()))


def test_splits_by_cells_are_those_of_all_pairs(spark):
    samples, spans = drawn(spark)
    pairs = workouts.kilometre_splits(intervals.points_in(samples, spans, ["k"], "start_ts", "ws", "we", True), ["name"], "we")
    got = told(workouts.splits_of_spans(samples, spans, ["k"], ["name"], "ws", "we"))
    assert len(got) > 200 and got == told(pairs)


def test_no_window_over_all_pairs(spark):
    samples, spans = drawn(spark)
    records = samples.withColumn("type", F.lit("distance_walking_running")).withColumnRenamed("k", "subject_id")
    chosen = spans.select(F.col("k").alias("subject_id"), F.col("name").alias("row_hash"), F.col("ws").alias("start_ts"), F.col("we").alias("end_ts"))
    found = workout_details(chosen, records, records, include="splits")["splits"]
    assert "windowspecdefinition" not in found._jdf.queryExecution().toString()


def test_pairs_at_a_time_do_not_matter(monkeypatch):
    draw = random.Random(3)
    cell = pa.RecordBatch.from_pylist(
        [{"_at": moment(n), "_value": draw.choice([0.5, 2.0])} for n in range(60)] + [{"_key0": n, "_start": moment(a := draw.randrange(50)), "_end": moment(a + draw.randrange(30))} for n in range(25)],
        pa.schema([("_at", pa.timestamp("us")), ("_value", pa.float64()), ("_key0", pa.int64()), ("_start", pa.timestamp("us")), ("_end", pa.timestamp("us"))]),
    )
    split = lambda: [b.to_pylist() for b in workouts.splitter(1, ["w"])(iter([cell.slice(0, 70), cell.slice(70)]))]
    whole = split()
    monkeypatch.setattr(workouts, "PAIRS", 40)
    parts = split()
    assert len(whole) == 1 and len(parts) > 5 and sum(parts, []) == whole[0]
