"""Imports: XML, archives, deltas and the stream, with the counts that the rules give."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pulseframe.sources import archive, ndjson, xml
from pulseframe.plans.maintenance import rebuild
from pulseframe.sources.sink import Store, verify
from pulseframe.streaming import delta

Q = "HKQuantityTypeIdentifier"


def at(clock, day="2025-06-03"):
    return f"{day} {clock} +0200"


def record(kind, value, start, end=None, source="Kim's Watch", unit="count/min"):
    return f'<Record type="{kind}" sourceName="{source}" sourceVersion="3" unit="{unit}" creationDate="{start}" startDate="{start}" endDate="{end or start}" value="{value}"/>'


#: A morning of readings by two devices, a short sleep, a ride of two parts, and the day's summary.
EXPORT = f"""<?xml version="1.0" encoding="UTF-8"?>
<HealthData locale="de">
 <ExportDate value="{at("21:15:00")}"/>
 {record(Q + "RespiratoryRate", 14.5, at("05:05:00"))}
 {record(Q + "RespiratoryRate", 15.25, at("05:05:00"), source="Kim's Phone")}
 {record(Q + "StepCount", 431, at("06:40:00"), at("06:55:00"), unit="count")}
 {record("HKCategoryTypeIdentifierSleepAnalysis", "HKCategoryValueSleepAnalysisAsleepREM", at("03:10:00"), at("03:52:00"))}
 <Record type="{Q}BodyMass" sourceName="Hall &lt;upstairs&gt;" unit="kg" creationDate="{at("06:30:00")}" startDate="{at("06:30:00")}" endDate="{at("06:30:00")}" value="64.2">
  <MetadataEntry key="note" value="after breakfast"/>
 </Record>
 <Workout workoutActivityType="HKWorkoutActivityTypeCycling" sourceName="Kim's Watch" duration="75.25" durationUnit="min" totalDistance="24" totalDistanceUnit="km" startDate="{at("17:20:00")}" endDate="{at("18:35:15")}">
  <MetadataEntry key="HKAverageMETs" value="7.1"/>
  <WorkoutEvent type="HKWorkoutEventTypeLap" date="{at("17:20:00")}" duration="12" durationUnit="min"/>
  <WorkoutEvent type="HKWorkoutEventTypeMotionPaused" date="{at("17:50:00")}"/>
  <WorkoutActivity uuid="ride-a" startDate="{at("17:20:00")}" endDate="{at("17:32:00")}" duration="12" durationUnit="min">
   <WorkoutEvent type="HKWorkoutEventTypeLap" date="{at("17:20:00")}" duration="12" durationUnit="min"/>
   <WorkoutStatistics type="{Q}HeartRate" average="141" minimum="98" maximum="159" unit="count/min"/>
   <WorkoutStatistics type="{Q}DistanceCycling" sum="3.9" unit="km"/>
   <WorkoutStatistics type="{Q}CyclingCadence" average="82" unit="count/min"/>
   <MetadataEntry key="WOIntervalStepKeyPath" value="3.2.end"/>
   <MetadataEntry key="WOIntervalStepSuccessful" value=" No "/>
   <MetadataEntry key="HKElevationAscended" value="4150 cm"/>
  </WorkoutActivity>
  <WorkoutActivity uuid="ride-b" startDate="{at("17:32:00")}" endDate="{at("17:35:00")}" duration="3" durationUnit="min"/>
  <WorkoutStatistics type="{Q}HeartRate" average="0" maximum="168" unit="count/min"/>
  <WorkoutStatistics type="{Q}ActiveEnergyBurned" sum="610" unit="kcal"/>
  <WorkoutStatistics type="{Q}DistanceCycling" sum="24.6" unit="km"/>
 </Workout>
 <ActivitySummary dateComponents="2025-06-03" activeEnergyBurned="905" activeEnergyBurnedGoal="700" activeEnergyBurnedUnit="kcal" appleExerciseTime="83" appleStandHours="10"/>
 <ClinicalRecord type="HKClinicalTypeIdentifierAllergyRecord" identifier="K-9" sourceName="Praxis am Markt" fhirVersion="4.0.1" receivedDate="{at("11:45:00", "2025-05-28")}"/>
</HealthData>
"""


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.xml"
    path.write_text(EXPORT, encoding="utf-8")
    return str(path)


def zipped(tmp_path, text=EXPORT, name="data/export.xml"):
    path = tmp_path / "export.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("data/deeper/export.xml", "<HealthData/>")
        out.writestr(name, text)
        out.writestr("data/export_cda.xml", "<x/>")
    return str(path)


def check(frames):
    counts = {n: f.count() for n, f in frames.items()}
    assert counts == {"records": 5, "sleep": 1, "workouts": 1, "workout_events": 5, "activity_summary": 1, "clinical": 1}
    kinds = sorted(r.type for r in frames["records"].collect())
    assert kinds == ["respiratory_rate", "respiratory_rate", "sleep_analysis", "step_count", "weight"]
    night = frames["sleep"].first()
    assert night.stage == "rem" and (night.end_ts - night.start_ts).total_seconds() == 42 * 60
    ride = frames["workouts"].first()
    assert (ride.type, ride.duration, ride.distance, ride.energy, ride.avg_hr, ride.max_hr) == ("cycling", 75.25, 24.6, 610.0, None, 168.0)
    steps = {(r.event_kind, r.step_index): r for r in frames["workout_events"].collect()}
    part = steps["activity", 0]
    assert (part.step_block, part.step_repeat, part.step_slot, part.step_successful) == (3, 2, None, False)
    assert (part.avg_hr, part.min_hr, part.max_hr, part.distance, part.elevation_ascended, part.elevation_unit) == (141.0, 98.0, 159.0, 3.9, 4150.0, "cm")
    assert list(json.loads(part.stats_json)) == ["CyclingCadence", "DistanceCycling", "HeartRate"]
    lap, rest = steps["event", 0], steps["event", 1]
    assert lap.event_type == "lap" and (lap.end_ts - lap.start_ts).total_seconds() == 720
    assert rest.event_type == "motion_paused" and rest.end_ts is None and rest.activity_uuid is None
    assert steps["activity_event", 0].activity_uuid == "ride-a"
    assert steps["activity", 1].stats_json is None
    assert frames["clinical"].first().identifier == "K-9" and frames["activity_summary"].first().exercise_minutes == 83.0


def test_xml_file(spark, export):
    check(xml.export_frames(spark, export))


def test_archive(spark, tmp_path):
    path = zipped(tmp_path)
    check(xml.export_frames(spark, path))
    only = xml.workout_frames(spark, path)
    assert set(only) == {"workouts", "workout_events"} and only["workout_events"].count() == 5
    assert archive.newest(str(tmp_path)) == path
    state = str(tmp_path / "state.json")
    assert not archive.imported(state, path)
    archive.remember(state, path)
    assert archive.imported(state, path)


def test_truncated_export_keeps_what_is_whole(spark, tmp_path):
    cut = EXPORT[: EXPORT.index('<Record type="HKQuantityTypeIdentifierBodyMass"') + 60]
    path = zipped(tmp_path, cut)
    assert xml.export_frames(spark, path)["records"].count() == 4
    plain = tmp_path / "cut.xml"
    plain.write_text(cut, encoding="utf-8")
    assert xml.records(xml.read_elements(spark, str(plain), "Record")).count() == 4


def test_elements_across_blocks():
    import io

    text = EXPORT.encode()
    whole = list(archive.elements(io.BytesIO(text)))
    assert len(whole) == 8 and whole == list(archive.elements(io.BytesIO(text), block=7))


def test_import_twice_adds_nothing(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = store.ingest(xml.export_frames(spark, export), "a.zip")
    assert first == {"records": 5, "sleep": 1, "workouts": 1, "workout_events": 5, "activity_summary": 1, "clinical": 1}
    assert set(store.ingest(xml.export_frames(spark, export), "a.zip").values()) == {0}
    views = store.views()
    assert [r.value for r in views["records_dedup"].filter("type = 'respiratory_rate'").collect()] == [14.5]
    assert views["import_runs"].count() == 2
    linked = views["workout_events"].join(views["workouts"].select(F.col("row_hash").alias("workout_hash")), "workout_hash")
    assert linked.count() == 5
    for name in ("records", "workouts", "workout_events", "sleep", "clinical"):
        assert verify(store.read(name), name) == {"wrong_hash": 0, "wrong_link": 0, "duplicate_keys": 0}
    assert rebuild(store, "records") == {"before": 5, "after": 5, "swapped": True, "against": []}
    assert store.read("records").count() == 5 and verify(store.read("records"), "records") == {"wrong_hash": 0, "wrong_link": 0, "duplicate_keys": 0}


def test_two_athletes_share_a_store(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for who in ("a", "b"):
        assert store.ingest(xml.export_frames(spark, export), subject=who)["records"] == 5
    assert store.ingest(xml.export_frames(spark, export), subject="a")["records"] == 0
    assert store.views()["records_dedup"].filter("type = 'respiratory_rate'").count() == 2
    assert verify(store.read("workout_events"), "workout_events")["wrong_link"] == 0


def test_identity_ignores_session_zone_and_float_noise(spark):
    from pulseframe.sources.identity import record_hash

    def hashes(values, zone="UTC"):
        old = spark.conf.get("spark.sql.session.timeZone")
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = spark.createDataFrame([(v,) for v in values], "value double").select(
                F.lit("hrv").alias("type"), F.lit("w").alias("source_name"), F.lit("ms").alias("unit"), "value", F.lit(None).cast("string").alias("value_str"),
                F.timestamp_micros(F.lit(1_700_000_000_123_456)).alias("start_ts"), F.timestamp_micros(F.lit(1_700_000_000_000_000)).alias("end_ts"),
            )
            return {r[0] for r in rows.select(record_hash()).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", old)

    assert len(hashes([0.000241262, 0.000241263, 0.000241264])) == 3
    assert len(hashes([35.7799987792969, 35.78])) == 1
    assert hashes([35.78]) == hashes([35.78], "Europe/Moscow") == hashes([35.78], "America/New_York")


def lines(extra=()):
    """The export's day as a delta tells it, with instants in UTC."""
    day = "2025-06-03T"
    ride = {"raw_type": "HKWorkoutActivityTypeCycling", "source_name": "Kim's Watch", "start": f"{day}15:20:00Z", "end": f"{day}16:35:15Z"}
    return [
        {"kind": "record", "raw_type": Q + "RespiratoryRate", "source_name": "Kim's Watch", "unit": "count/min", "value": 14.5, "start": f"{day}03:05:00.250Z", "end": f"{day}05:05:00+02:00", "created": f"{day}03:05:00Z"},
        {"kind": "record", "raw_type": "HKCategoryTypeIdentifierSleepAnalysis", "source_name": "Kim's Watch", "unit": "count/min", "value_str": "HKCategoryValueSleepAnalysisAsleepREM", "start": f"{day}01:10:00Z", "end": f"{day}01:52:00Z"},
        {"kind": "workout", "duration": 75.25, "duration_unit": "min", "distance": 24.6, "distance_unit": "km", "avg_hr": 0, "max_hr": 168, **ride},
        {"kind": "workout_activity", "workout": ride, "activity_uuid": "ride-a", "step_index": 0, "start": f"{day}15:20:00Z", "end": f"{day}15:32:00Z", "duration": 12, "duration_unit": "min", "metadata": {"WOIntervalStepKeyPath": "3.2.end"}, "statistics": [{"raw_type": Q + "HeartRate", "average": 141, "unit": "count/min"}]},
        {"kind": "workout_event", "workout": ride, "raw_event_type": "HKWorkoutEventTypeLap", "date": f"{day}15:20:00Z", "duration": 12, "duration_unit": "min", "step_index": 0},
        {"kind": "activity_summary", "date": "2025-06-03"},
        *extra,
    ]


BAD = [{"kind": "record", "raw_type": Q + "RespiratoryRate", "value": 9, "start": "2025-06-03 03:05:00", "end": "2025-06-03T03:05:00Z"}, {"kind": "riddle"}, {"raw_type": "x"}, {"kind": "workout_event", "date": "2025-06-03T15:20:00Z", "step_index": 4}]


def write_batch(folder, name, objects, broken="{not json"):
    folder.mkdir(exist_ok=True)
    with gzip.open(folder / name, "wt", encoding="utf-8") as out:
        out.write("\n".join([json.dumps(o) for o in objects] + ([broken] if broken else [])))


def test_delta_after_export_adds_only_what_is_new(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(xml.export_frames(spark, export))
    write_batch(tmp_path / "in", "b1.ndjson.gz", lines())
    added = delta.import_batch(store, ndjson.read_lines(spark, str(tmp_path / "in")), 1)
    assert added == {"records": 0, "sleep": 0, "workouts": 0, "workout_events": 0}


def test_bad_lines_are_set_aside(spark, tmp_path):
    write_batch(tmp_path / "in", "b1.ndjson.gz", lines(BAD))
    found = ndjson.read_lines(spark, str(tmp_path / "in"))
    reasons = sorted(r.reason for r in ndjson.rejected(found).collect())
    assert len(reasons) == 5 and any("unknown kind riddle" in r for r in reasons)
    frames = ndjson.delta_frames(found)
    assert {n: f.count() for n, f in frames.items()} == {"records": 2, "sleep": 1, "workouts": 1, "workout_events": 2}
    assert frames["workouts"].first().avg_hr is None


def test_stream_redelivery_and_restart(spark, tmp_path):
    landing, store, checkpoint = tmp_path / "in", Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    write_batch(landing, "b1.ndjson.gz", lines(BAD))
    delta.start(spark, str(landing), store, checkpoint).awaitTermination(120)
    assert store.read("records").count() == 2 and spark.read.parquet(store.path("rejected")).count() == 5
    more = {"kind": "record", "raw_type": Q + "HeartRate", "source_name": "Kim's Watch", "unit": "count/min", "value": 58, "start": "2023-11-20T22:00:00Z", "end": "2023-11-20T22:00:00Z"}
    write_batch(landing, "b2.ndjson.gz", lines([more]), broken=None)  # the first batch again, and a late sample
    delta.start(spark, str(landing), store, checkpoint).awaitTermination(120)
    assert store.read("records").count() == 3 and store.read("workouts").count() == 1
    delta.start(spark, str(landing), store, checkpoint).awaitTermination(120)
    assert store.read("records").count() == 3


def test_a_repeated_batch_is_recorded_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write_batch(tmp_path / "in", "b1.ndjson.gz", lines(BAD))
    for _ in range(2):
        delta.import_batch(store, ndjson.read_lines(spark, str(tmp_path / "in")), 7, run="q")
    assert store.read("import_runs").count() == 1 and spark.read.parquet(store.path("rejected")).count() == 5


def test_waits_and_keeps_what_fails(spark, tmp_path, monkeypatch):
    landing, store, checkpoint = tmp_path / "in", Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    landing.mkdir()
    pending = lambda **more: delta.import_pending(spark, str(landing), store, checkpoint, **more)
    assert pending(wait_seconds=0.1, poll=0.1) == {"state": "nothing has arrived", "rows": 0, "failed": 0}
    assert delta.diagnostics(store)["notes"] == ["no delta has been imported yet"]
    write_batch(landing, "b1.ndjson.gz", lines(BAD))
    assert pending() == {"state": "imported", "rows": 11, "failed": 0}

    def broken(*_, **__):
        raise ValueError("no such unit")

    with monkeypatch.context() as m:
        m.setattr(delta, "import_batch", broken)
        write_batch(landing, "b2.ndjson.gz", lines(), broken=None)
        assert pending() == {"state": "imported", "rows": 6, "failed": 1}
    told = delta.diagnostics(store)
    assert sum(told["rejected"].values()) == 5 and list(told["failed"].values()) == ["ValueError: no such unit"] and len(told["notes"]) == 2
    assert spark.read.parquet(store.path("failed")).count() == 6


def test_first_writer_wins_in_any_order(spark, tmp_path):
    from pulseframe.sources.sink import new_rows

    rows = [("a", 2, "x"), ("a", 1, "z"), ("b", 3, None), ("b", 3, "y"), ("c", 1, "q")]
    table = spark.createDataFrame([("c", 5, "old")], "k string, n int, t string")
    for order in (rows, rows[::-1]):
        got = new_rows(spark.createDataFrame(order, table.schema).repartition(3), table, ["k"]).collect()
        assert sorted(map(tuple, got), key=repr) == [("a", 1, "z"), ("b", 3, None)]


def test_a_batch_reads_its_months_alone(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.ingest(xml.export_frames(spark, export))
    assert [p.name for p in (tmp_path / "store" / "records").glob("*/month=*")] == ["month=2025-06"]
    assert "month" not in store.read("records").columns


def test_reload_skips_what_is_in(spark, tmp_path):
    from pulseframe.plans.maintenance import gates, link_report
    from pulseframe.sources.reload import reload

    folder = tmp_path / "exports"
    folder.mkdir()
    store, state = Store(spark, str(tmp_path / "store")), str(tmp_path / "state.json")
    assert reload(store, str(folder), state)["state"] == "no archive"
    path = zipped(folder)
    assert reload(store, path, state, workouts_only=True)["added"] == {"workouts": 1, "workout_events": 5}
    first = reload(store, str(folder), state)
    assert first["state"] == "imported" and first["added"]["records"] == 5 and first["added"]["workouts"] == 0
    assert reload(store, str(folder), state)["state"] == "already imported"
    assert set(reload(store, str(folder), state, force=True)["added"].values()) == {0}
    report = link_report(store.read("workout_events"), store.read("workouts"))
    assert report == {"total": 5, "deduped": 5, "reps": 2, "orphans": 0, "linked_workouts": 1, "interval_sessions": 1}
    assert gates(report, report, 100, 99, 99) == [] and len(gates(report, report | {"orphans": 1}, 100, 90, 91)) == 3


def folders_of(store, name):
    return store.files.names(store.path(name))


def some_records(spark, numbers, value=None):
    rows = [("heart_rate", "HR", "Watch", "bpm", float(i if value is None else value), f"2024-0{1 + i % 3}-10 10:00:{i % 60:02}") for i in numbers]
    df = spark.createDataFrame(rows, "type string, raw_type string, source_name string, unit string, value double, at string")
    null = [F.lit(None).cast("string").alias(c) for c in ("source_version", "device", "value_str")]
    return df.select("type", "raw_type", "source_name", "unit", "value", *null, F.to_timestamp("at").alias("start_ts"), F.to_timestamp("at").alias("end_ts"), F.to_timestamp("at").alias("created_ts"), F.lit(30).alias("source_priority"))


def test_an_import_that_fails_leaves_nothing(spark, export, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    frames = xml.export_frames(spark, export)
    broken = frames | {"clinical": frames["clinical"].withColumn("type", F.raise_error(F.lit("torn page")))}
    with pytest.raises(Exception, match="torn page"):
        store.ingest(broken)
    assert store.state()["version"] == 0 and store.read("records").count() == 0
    assert not any(folders_of(store, name) for name in ("records", "sleep", "workouts", "_parsed"))
    assert store.ingest(frames)["records"] == 5 and store.state()["version"] == 1


def test_a_reader_keeps_its_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.ingest({"records": some_records(spark, range(4))})
    early = store.state()
    store.ingest({"records": some_records(spark, range(9))})
    assert store.read("records", early).count() == 4 and store.read("records").count() == 9
    assert store.rows("records") == 9 and [r.records_total for r in store.read("import_runs").orderBy("imported_at").collect()] == [4, 9]


def test_of_two_writers_the_later_one_looks_again(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    store.ingest({"records": some_records(spark, range(3))})
    commit, raced = store.commits.commit, []

    def late(state):
        if not raced:
            raced.append(other.ingest({"records": some_records(spark, range(2, 6))}))
        commit(state)

    monkeypatch.setattr(store.commits, "commit", late)
    assert store.ingest({"records": some_records(spark, range(8))}) == {"records": 2} and raced == [{"records": 3}]
    assert store.read("records").count() == 8 and store.read("records").select("row_hash").distinct().count() == 8
    assert len(folders_of(store, "records")) == 3 and store.read("import_runs").count() == 3


def test_compaction_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for i in range(6):
        store.ingest({"records": some_records(spark, range(i * 3, i * 3 + 4))})
    before = sorted(r.row_hash for r in store.read("records").collect())
    assert store.compact(most=10) == {} and len(folders_of(store, "records")) == 6
    assert store.compact(most=3) == {"records": 6, "import_runs": 6}
    assert sorted(r.row_hash for r in store.read("records").collect()) == before and store.rows("records") == len(before) == 19
    assert len(store.vacuum()) == 12 and len(folders_of(store, "records")) == 1
    assert sorted(r.row_hash for r in store.read("records").collect()) == before
    assert store.ingest({"records": some_records(spark, range(19))}) == {"records": 0}
    assert store.compact(most=0, small=5) == {} or store.read("records").count() == 19  # large folders stay


def test_rebuild_stops_at_its_gates(spark, tmp_path):
    from pulseframe.plans import maintenance

    store = Store(spark, str(tmp_path / "store"))
    store.ingest({"records": some_records(spark, range(10))})
    wrong = store.read("records").withColumn("row_hash", F.md5("row_hash"))
    store.add("records", wrong.limit(4))  # four readings a second time, under hashes of another make
    assert store.read("records").count() == 14
    told = maintenance.rebuild(store, "records")
    assert not told["swapped"] and told["after"] == 10 and "collapsed" in told["against"][0] and store.read("records").count() == 14
    assert len(folders_of(store, "records")) == 2
    assert maintenance.rebuild(store, "records", max_collapse=0.5)["swapped"] and store.read("records").count() == 10
    assert verify(store.read("records"), "records") == {"wrong_hash": 0, "wrong_link": 0, "duplicate_keys": 0}


def test_rebuild_doesnt_lose_what_came_meanwhile(spark, tmp_path, monkeypatch):
    from pulseframe.plans import maintenance

    store, other = (Store(spark, str(tmp_path / "store")) for _ in range(2))
    store.ingest({"records": some_records(spark, range(5))})
    replace = store.replace

    def late(*args):
        other.ingest({"records": some_records(spark, range(5, 7))})
        replace(*args)

    monkeypatch.setattr(store, "replace", late)
    told = maintenance.rebuild(store, "records")
    assert not told["swapped"] and "has changed since" in told["against"][0] and store.read("records").count() == 7


def test_a_failed_batch_is_taken_up_again(spark, tmp_path):
    landing, store, checkpoint = tmp_path / "in", Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")

    def refuse(frame, number):
        raise ValueError("out of order")

    write_batch(landing, "b1.ndjson.gz", lines(BAD))
    delta.start(spark, str(landing), store, checkpoint, accept=refuse).awaitTermination(120)
    assert store.read("records").count() == 0 and len(delta.kept_batches(store, "failed")) == 1
    assert delta.retry_failed(store, accept=refuse) == {}
    row = delta.batch_states(store).first()
    assert (row.state, row.tries, row.failure) == ("failed", 2, "ValueError: out of order")
    added = delta.retry_failed(store)
    assert [a["records"] for a in added.values()] == [2] and store.read("records").count() == 2
    row = delta.batch_states(store).first()
    assert (row.state, row.tries) == ("retried", 3) and delta.retry_failed(store) == {}
    assert spark.read.parquet(store.path("rejected")).count() == 5


def test_other_errors_stop_the_stream(spark, tmp_path, monkeypatch):
    landing, store, checkpoint = tmp_path / "in", Store(spark, str(tmp_path / "store")), str(tmp_path / "checkpoint")
    write_batch(landing, "b1.ndjson.gz", lines(BAD))

    def broken(*_, **__):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(delta, "import_batch", broken)
        with pytest.raises(Exception, match="disk full"):
            delta.start(spark, str(landing), store, checkpoint).awaitTermination(120)
    assert delta.kept_batches(store, "failed") == []
    delta.start(spark, str(landing), store, checkpoint).awaitTermination(120)  # repeats the batch
    assert store.read("records").count() == 2
