"""Nights scored as they come are scored as all at once, late and repeated ones too."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.plans import recovery
from pulseframe.streaming import nights as stream

FIRST = dt.date(2024, 1, 1)


def some_nights(days, athletes, seed):
    draw = random.Random(seed)
    maybe = lambda v: v if draw.random() < 0.9 else None
    return [
        (a, FIRST + dt.timedelta(d), draw.uniform(4, 9), maybe(draw.uniform(0, 4)), draw.randrange(5), dt.datetime.combine(FIRST + dt.timedelta(d), dt.time(draw.randrange(20, 24), draw.randrange(60))), maybe(draw.uniform(30, 90)), maybe(draw.uniform(45, 60)), maybe(draw.uniform(12, 16)), maybe(draw.uniform(35, 37)))
        for a in athletes for d in days
    ]


SCHEMA = "subject_id int, night date, hours_asleep double, deep_rem_h double, awakenings long, bed_start timestamp, hrv double, sleeping_hr double, resp double, temp double"


def test_streamed_scores_are_those_of_all_nights(spark, tmp_path):
    rows = some_nights(range(100), (1, 2), 1) + some_nights(range(95, 100), (3,), 2)
    nights = spark.createDataFrame(rows, SCHEMA)
    day = F.datediff("night", F.lit(FIRST))
    late = (day % 11 == 5) & (day >= 70)
    parts = [~late & (day < 40), ~late & (day < 90), late & (day < 90), day.between(88, 99), day.between(97, 99)]  # late nights, then some again
    for part in parts:
        stream.prepared(nights.filter(part), "subject_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        stream.start(spark, str(tmp_path / "landing"), str(tmp_path / "scores"), str(tmp_path / "checkpoint"), "subject_id", T.IntegerType()).awaitTermination(300)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    columns = ["subject_id", "night", "state", "history_days", "score", "band", "confidence", "ci", "hrv_z", "sleeping_hr_z", "temp_score", "sleep_score", "hrv_cv_samples"]
    told = lambda df: sorted(map(plain, df.select(columns).collect()))
    assert told(stream.scores(spark, str(tmp_path / "scores"), "subject_id")) == told(recovery.scored_nights(recovery.with_windows(nights, ["subject_id"]), ["subject_id"]))


def test_state_keeps_two_windows(spark):
    held = {d: [1.0 * d, float(d), None, 3.0, 4.0, 5.0, 6.0, 7.0] for d in range(60)}
    told = stream.windows(40, held, 0, recovery.sc.DEFAULT)
    assert told["hrv_base"] == [float(d) for d in range(12, 40)] and told["sleeping_hr_base"] == [] and told["history_days"] == 40
    assert told["hrv_recent"] == [float(d) for d in range(41 - recovery.sc.DEFAULT.smoothing_days, 41)]
