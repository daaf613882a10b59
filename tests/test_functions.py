"""Column functions on their edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import identifiers as ids
from pulseframe.functions import scores as sc
from pulseframe.functions import times as tm
from pulseframe.functions import training as tr


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("HKQuantityTypeIdentifierHeartRateVariabilitySDNN", "hrv"), ("HKQuantityTypeIdentifierRunningPower", "running_power"), ("HKWorkoutActivityTypeTraditionalStrengthTraining", "traditional_strength_training"),
        ("HKCategoryTypeIdentifierAppleStandHour", "stand_hour"), ("", "unknown"), (None, "unknown"), ("SomethingElse2Do", "something_else2_do"), ("HKDataTypeIdentifier", "hk_data_type_identifier"),
    ],
)
def test_metric_type(spark, raw, name):
    assert one(spark, ids.metric_type(F.lit(raw).cast("string"))) == name


@pytest.mark.parametrize(("raw", "stage"), [("HKCategoryValueSleepAnalysisAsleepREM", "rem"), ("HKCategoryValueSleepAnalysisNapping", "napping"), (None, "unknown"), ("HKCategoryValueSleepAnalysis", "unknown")])
def test_sleep_stage(spark, raw, stage):
    assert one(spark, ids.sleep_stage(F.lit(raw).cast("string"))) == stage


@pytest.mark.parametrize(("name", "priority"), [("Ana's Apple Watch", 30), ("iPhone", 20), ("iPad", 10), ("Scale", 5), (None, 5)])
def test_source_priority(spark, name, priority):
    assert one(spark, ids.source_priority(F.lit(name).cast("string"))) == priority


@pytest.mark.parametrize(("text", "value"), [("1.5", 1.5), (" 2 ", 2.0), ("1e3", 1000.0), ("1d", None), ("x", None), ("", None), (None, None), ("inf", math.inf)])
def test_number(spark, text, value):
    assert one(spark, ids.number(F.lit(text).cast("string"))) == value


def test_quantities_and_units(spark):
    number, unit = ids.quantity(F.lit("262 cm"))
    assert (one(spark, number), one(spark, unit)) == (262.0, "cm")
    assert one(spark, ids.step_km(F.lit(1.0), F.lit("mi"))) == pytest.approx(1.609344) and one(spark, ids.step_km(F.lit(1.0), F.lit("league"))) is None
    assert one(spark, ids.step_minutes(F.lit(90.0), F.lit("s"), F.lit(None), F.lit(None))) == 1.5
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-01 00:00:00", "2024-01-01 00:03:00"))
    assert one(spark, ids.step_minutes(F.lit(90.0), F.lit("blinks"), start, end)) == 3.0
    assert one(spark, ids.batch_id(F.lit("a b/c:" + "x" * 90))) == "a_b_c_" + "x" * 74


@pytest.mark.parametrize(("text", "night"), [("2024-01-14 23:30:00", "2024-01-15"), ("2024-01-15 03:00:00", "2024-01-15"), ("2024-01-15 17:59:59", "2024-01-15"), ("2024-01-15 18:00:00", "2024-01-16")])
def test_nights(spark, text, night):
    ts = F.lit(text).cast("timestamp")
    assert str(one(spark, tm.wake_day(ts))) == night == str(one(spark, tm.onset_night(ts)))


def test_times(spark):
    assert one(spark, tm.seconds(F.lit("2024-01-01 00:00:01.1").cast("timestamp")) - tm.seconds(F.lit("2024-01-01 00:00:00.9").cast("timestamp"))) == 1
    assert one(spark, tm.wired(F.lit("2024-01-01T00:00:00"))) is None and one(spark, tm.wired(F.lit("2024-01-01T02:00:00.9+02:00"))).isoformat() == "2024-01-01T00:00:00"
    assert one(spark, tm.exported(F.lit("2024-01-15 08:30:00 -0800"))).isoformat() == "2024-01-15T16:30:00"
    assert one(spark, tm.exported(F.lit("yesterday"))) is None
    assert one(spark, tm.bed_hours(F.lit("2024-01-01 23:30:00").cast("timestamp"))) == -0.5
    assert one(spark, tm.minutes_past_18(F.lit("2024-01-01 00:30:00").cast("timestamp"))) == 390


def test_training(spark):
    assert one(spark, tr.pace(F.lit(12.0))) == 5.0 and one(spark, tr.pace(F.lit(0.0))) is None
    assert one(spark, tr.cadence(F.lit(12.0), F.lit(1.2))) == 166.7
    assert one(spark, tr.trimp(F.lit(60.0), F.lit(150.0), F.lit(60.0), F.lit(190.0))) == pytest.approx(60 * (90 / 130) * 0.64 * math.exp(1.92 * 90 / 130), abs=0.06)
    assert one(spark, tr.trimp(F.lit(60.0), F.lit(150.0), F.lit(60.0), F.lit(60.0))) is None
    assert one(spark, tr.drift(F.lit(0.0), F.lit(1.0))) is None and one(spark, tr.drift(F.lit(2.0), F.lit(2.1))) == 5.0
    zones = [one(spark, tr.zone_of(F.lit(v).cast("double"), tr.named_bounds())) for v in (40, 149.9, 150, 165.4, 166, 186.9, 187, None)]
    assert zones == ["recovery", "recovery", "easy", "easy", "grey", "threshold", "vo2max", None]
    assert one(spark, tr.clock(F.lit(4.5))) == "4:30"


def test_zone_files(tmp_path):
    import json

    def path(zones):
        file = tmp_path / "zones.json"
        file.write_text(json.dumps({"zones": zones}))
        return str(file)

    good = [{"name": "low", "min_bpm": None, "max_bpm": 140}, {"name": "high", "min_bpm": 141, "max_bpm": None}]
    assert tr.named_bounds(path(good)) == [("low", 0.0), ("high", 141.0)]
    assert tr.named_bounds(str(tmp_path / "none.json")) == list(tr.NAMED_ZONES)
    for wrong in ([good[0]], [good[0], {**good[1], "min_bpm": 150}], [{**good[0], "name": "a b"}, good[1]], [good[0], {**good[1], "name": "low"}], [{**good[0], "max_bpm": 140.5}, good[1]]):
        with pytest.raises(ValueError, match="."):
            tr.named_bounds(path(wrong))


def test_scores(spark):
    values = {
        50.0: sc.hrv_score(F.lit(0.0)), 66.6: sc.hrv_score(F.lit(1.0)), 32.0: sc.higher_is_worse(F.lit(1.0)), 64.0: sc.temperature_score(F.lit(1.0)), 82.0: sc.temperature_score(F.lit(-1.0)),
        80.0: sc.duration_score(F.lit(7.0), F.lit(8.0)), 90.0: sc.duration_score(F.lit(9.0), F.lit(8.0)), 7.5: sc.sleep_need(F.lit(7.5), F.lit(5)), 8.0: sc.sleep_need(F.lit(7.0), F.lit(4)), 6.5: sc.sleep_need(F.lit(4.0), F.lit(9)),
        3.0: sc.load_penalty(F.lit(1.4), F.lit(None).cast("double")), 10.0: sc.load_penalty(F.lit(1.6), F.lit(0.0)), 40.0: sc.load_penalty(F.lit(3.0), F.lit(10.0)),
    }
    for want, column in values.items():
        assert one(spark, column) == pytest.approx(want)
    null = F.lit(None).cast("double")
    for column in (sc.hrv_score(null), sc.temperature_score(null), sc.band(null), sc.sleep_score(null, F.lit(8.0), null, null, null)):
        assert one(spark, column) is None
    assert one(spark, sc.sleep_score(F.lit(8.0), F.lit(8.0), F.lit(0.45), F.lit(1.0), null)) == pytest.approx((100 * 0.6 + 100 * 0.15 + 92 * 0.15) / 0.9, abs=0.06)
    ill = sc.illness({"temp": F.lit(1.5), "resp": null, "sleeping_hr": F.lit(0.5), "hrv": F.lit(-2.0)})
    assert [one(spark, ill[k]) for k in ("count", "pressure", "triggered", "signals")] == [2, 1.5, True, ["temp", "hrv"]]
    assert one(spark, sc.readiness(F.lit(90.0), F.lit(5.0), F.lit(True))) == 66.0 and one(spark, sc.readiness(F.lit(20.0), F.lit(40.0), F.lit(False))) == 0.0
    kept = sc.recovery({"hrv": F.lit(80.0), "sleep": F.lit(60.0), "resp": null}, {"hrv": F.lit(1.0), "sleep": F.lit(0.5), "resp": F.lit(1.0)})
    assert one(spark, kept["score"]) == round((80 * 0.4 + 60 * 0.125) / 0.525, 1) and one(spark, kept["confidence"]) == round(0.525 / 0.65, 3)
    nothing = sc.recovery({"hrv": F.lit(80.0)}, {"hrv": F.lit(0.0)})
    assert one(spark, nothing["score"]) == 80.0 and one(spark, nothing["ci"]) == 15.0
