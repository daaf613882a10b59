"""Sources, the store and the stream as queries: the driver's events written as exports and deltas, imported, and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Tables, identity_sql, query, rd
from .functions import identifiers as ids
from .functions import times as tm
from .sources import ndjson, xml
from .sources.sink import Store, verify
from .sources.workspace import workspace
from .streaming import delta

# The export's names of the adapters' metrics, stages and sports.
METRICS = {"heart_rate": "HeartRate", "step_count": "StepCount", "hrv": "HeartRateVariabilitySDNN", "active_energy": "ActiveEnergyBurned", "distance_walking_running": "DistanceWalkingRunning"}
STAGES = {"core": "AsleepCore", "deep": "AsleepDeep", "rem": "AsleepREM", "asleep": "AsleepUnspecified", "awake": "Awake", "in_bed": "InBed"}
SPORTS = {"running": "Running", "cycling": "Cycling"}


def joined(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def element(name: str, inside: tuple = (), **attributes: str | Column) -> Column:
    """An XML element on one line."""
    given = [x for key, value in attributes.items() for x in (f' {key}="', value, '"')]
    return joined(f"<{name}", *given, ">", *inside, f"</{name}>") if inside else joined(f"<{name}", *given, "/>")


def clock(ts: Column) -> Column:
    """As an export writes an instant; the tables' times are taken as UTC."""
    return joined(tm.utc_second(ts), " +0000")


def wire(ts: Column) -> Column:
    return F.concat(F.replace(tm.utc_second(ts), F.lit(" "), F.lit("T")), F.lit("Z"))


def exported_records(t: Tables) -> DataFrame:
    start = clock(F.col("start_ts").cast("timestamp"))
    return t.rec.select(
        element("Record", type=joined(ids.QUANTITY, ids.lookup(METRICS, F.col("type"))), sourceName=F.col("source_name"), unit=F.col("unit"), value=F.col("value"), startDate=start, endDate=start).alias("value")
    )


def exported_sleep(t: Tables) -> DataFrame:
    at = lambda c: clock(F.col(c).cast("timestamp"))
    stage = joined(ids.STAGE, ids.lookup(STAGES, F.col("stage")))
    return t.seg.select(element("Record", type=joined(ids.CATEGORY, "SleepAnalysis"), sourceName="Watch", value=stage, startDate=at("start_ts"), endDate=at("end_ts")).alias("value"))


def written(lines: DataFrame, path: str) -> None:
    """One document for each part of the lines."""

    def framed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["<HealthData>"])], names=["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</HealthData>"])], names=["value"])

    lines.mapInArrow(framed, "value string").write.text(path)


def imported(t: Tables, label: str, lines: DataFrame, kinds: tuple[str, ...]) -> tuple[Store, int]:
    """A store with one export's tables, and how many rows importing it again added."""
    spark, folder = t.spark, workspace(t.spark, label)
    written(lines, f"{folder}/export")
    store = Store(spark, f"{folder}/store")
    first, again = (store.ingest(xml.export_frames(spark, f"{folder}/export", kinds, f"{folder}/elements-{i}"), "export.xml") for i in range(2))
    return store, sum(again.values())


@query("import_records", f"SELECT DISTINCT {identity_sql()} AS row_hash, type, source_name, CAST(source_priority AS INT) AS source_priority, unit, CAST(epoch(start_ts) AS BIGINT) AS start, 0 AS added_again, 0 AS wrong FROM rec")
def import_records(t: Tables) -> DataFrame:
    """SRC-01, SRC-06, SC-05, SC-20, SNK-01, SNK-03, MG-02: an export's readings, imported twice and verified."""
    store, again = imported(t, "records", exported_records(t), ("records",))
    wrong = sum(verify(store.read("records"), "records").values())
    return store.read("records").select(
        "row_hash", "type", "source_name", "source_priority", "unit", tm.seconds(F.col("start_ts")).alias("start"), F.lit(again).alias("added_again"), F.lit(wrong).alias("wrong")
    )


STAGE_CASE = "CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items()) + " END"


@query("import_sleep", f"""SELECT DISTINCT md5(concat_ws('|', 'Watch', 'HKCategoryValueSleepAnalysis' || {STAGE_CASE}, strftime(start_ts, '%Y-%m-%d %H:%M:%S'), strftime(end_ts, '%Y-%m-%d %H:%M:%S'))) AS row_hash, stage,
  CAST(epoch(start_ts) AS BIGINT) AS start, CAST(epoch(end_ts) AS BIGINT) AS until, 0 AS added_again FROM seg""")
def import_sleep(t: Tables) -> DataFrame:
    """SRC-07, SC-03: records of sleep become segments too."""
    store, again = imported(t, "sleep", exported_sleep(t), ("sleep",))
    return store.read("sleep").select("row_hash", "stage", tm.seconds(F.col("start_ts")).alias("start"), tm.seconds(F.col("end_ts")).alias("until"), F.lit(again).alias("added_again"))


def exported_workouts(t: Tables) -> DataFrame:
    n, start, end = F.col("row_hash") % 60, clock(F.col("start_ts").cast("timestamp")), clock(F.col("end_ts").cast("timestamp"))
    quantity = lambda kind, **fields: element("WorkoutStatistics", type=joined(ids.QUANTITY, kind), **fields)
    entry = lambda key, value: element("MetadataEntry", key=key, value=value)
    lap = element("WorkoutEvent", type=ids.EVENT + "Lap", date=start, duration=n % 7 + 1, durationUnit="min")
    pause = element("WorkoutEvent", type=ids.EVENT + "MotionPaused", date=start)
    activity = element(
        "WorkoutActivity",
        (lap, quantity("HeartRate", minimum=100 + n, average=110 + n, maximum=130 + n, unit="count/min"), quantity("RunningPower", average=200 + n, unit="W"),
         entry(xml.KEY_PATH, joined(n % 3, ".", n % 5, ".x")), entry(xml.SUCCESS, F.when(n % 2 == 0, " Yes ").otherwise("no")), entry(xml.ELEVATION, joined(n, " m"))),
        uuid=joined("u", F.col("row_hash")), startDate=start, endDate=end, duration=F.col("duration"), durationUnit="min",
    )
    sport = ids.lookup(SPORTS, F.col("type"))
    distance = joined("Distance", F.when(F.col("type") == "running", "WalkingRunning").otherwise("Cycling"))
    inside = (
        lap, pause, activity, quantity("HeartRate", average=F.when(n == 0, F.lit(0.0)).otherwise(F.col("avg_hr")), maximum=F.col("max_hr"), unit="count/min"),
        quantity("ActiveEnergyBurned", sum=F.col("energy"), unit="kcal"), quantity(distance, sum=F.col("distance"), unit="km"),
    )
    own = t.wk.filter("source_name = 'Watch'")
    return own.select(
        element("Workout", inside, workoutActivityType=joined("HKWorkoutActivityType", sport), sourceName=joined("Watch ", F.col("row_hash")), duration=F.col("duration"), durationUnit="min", totalDistance="1", totalDistanceUnit="km", startDate=start, endDate=end).alias("value")
    )


@query("import_workouts", f"""SELECT md5(concat_ws('|', type, 'Watch ' || row_hash, strftime(start_ts, '%Y-%m-%d %H:%M:%S'), strftime(end_ts, '%Y-%m-%d %H:%M:%S'))) AS row_hash, type, duration, {rd("distance", 4)} AS distance, {rd("energy", 4)} AS energy,
  CASE WHEN row_hash % 60 > 0 THEN avg_hr END AS avg_hr, max_hr, CAST(4 AS BIGINT) AS steps, CAST(row_hash % 60 % 3 AS INT) AS step_block, CAST(row_hash % 60 % 5 AS INT) AS step_repeat, CAST(NULL AS INT) AS step_slot, row_hash % 60 % 2 = 0 AS step_successful,
  CAST(row_hash % 60 AS DOUBLE) AS elevation, 'm' AS elevation_unit, CAST(100 + row_hash % 60 AS DOUBLE) AS min_hr, CAST(200 + row_hash % 60 AS DOUBLE) AS avg_power, (row_hash % 60 % 7 + 1) * 60 AS lap_seconds,
  'activity,lap,lap,motion_paused' AS kinds, 0 AS added_again, 0 AS wrong FROM one""")
def import_workouts(t: Tables) -> DataFrame:
    """SRC-08..12, SC-04, SC-06, SC-07, SNK-02, JN-14: workouts with their statistics, and the structure that hangs on them."""
    store, again = imported(t, "workouts", exported_workouts(t), ("workouts", "workout_events"))
    events, key = store.read("workout_events"), F.col("workout_hash").alias("row_hash")
    wrong = sum(verify(events, "workout_events").values())
    told = F.coalesce("event_type", "event_kind")
    every = events.groupBy(key).agg(F.count(F.lit(1)).alias("steps"), F.array_join(F.array_sort(F.collect_list(told)), ",").alias("kinds"))
    part = events.filter("event_kind = 'activity'").select(key, "step_block", "step_repeat", "step_slot", "step_successful", F.col("elevation_ascended").alias("elevation"), "elevation_unit", "min_hr", "avg_power")
    lap = events.filter("event_kind = 'event' AND event_type = 'lap'").select(key, (tm.seconds(F.col("end_ts")) - tm.seconds(F.col("start_ts"))).alias("lap_seconds"))
    out = store.read("workouts").join(every, "row_hash").join(part, "row_hash").join(lap, "row_hash")
    return out.select(
        "row_hash", "type", "duration", F.round("distance", 4).alias("distance"), F.round("energy", 4).alias("energy"), "avg_hr", "max_hr", "steps", "step_block", "step_repeat", "step_slot", "step_successful",
        "elevation", "elevation_unit", "min_hr", "avg_power", "lap_seconds", "kinds", F.lit(again).alias("added_again"), F.lit(wrong).alias("wrong"),
    )


@query("import_days", """, d AS (SELECT strftime(start_ts, '%Y-%m-%d') AS day, count(*) AS n FROM rec GROUP BY ALL)
SELECT 'summary' AS what, day AS name, CAST(n AS DOUBLE) AS number, 'kcal' AS told FROM d UNION ALL SELECT 'clinical', md5(concat_ws('|', 'lab_result_record', 'L' || day, 'Clinic')), NULL, 'lab_result_record' FROM d""")
def import_days(t: Tables) -> DataFrame:
    """SRC-13, SRC-14, SNK-04: summaries of days (the first import of a day stands) and clinical entries."""
    days = t.rec.groupBy(F.date_format("start_ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    summary = lambda n: element("ActivitySummary", dateComponents=F.col("day"), activeEnergyBurned=n, activeEnergyBurnedUnit="kcal", appleExerciseTime="x")
    entry = element("ClinicalRecord", type="HKClinicalTypeIdentifierLabResultRecord", identifier=joined("L", F.col("day")), sourceName="Clinic", receivedDate=joined(F.col("day"), " 10:00:00 +0000"))
    kinds = ("activity_summary", "clinical")
    store, _ = imported(t, "days", days.select(F.explode(F.array(summary(F.col("n")), entry)).alias("value")), kinds)
    later = f"{workspace(t.spark, 'later')}/export"
    written(days.select(summary(F.col("n") + 1).alias("value")), later)
    store.ingest({k: v for k, v in xml.export_frames(t.spark, later).items() if k in kinds})
    found = store.read("activity_summary").filter("exercise_minutes IS NULL").select(F.lit("summary").alias("what"), F.col("date").alias("name"), F.col("active_energy").alias("number"), F.col("active_energy_unit").alias("told"))
    return found.unionByName(store.read("clinical").select(F.lit("clinical").alias("what"), F.col("row_hash").alias("name"), F.lit(None).cast("double").alias("number"), F.col("type").alias("told")))


@query("import_deltas", f""", good AS (SELECT * FROM rec WHERE row_hash % 50 > 2) SELECT type AS what, count(DISTINCT {identity_sql()}) AS n FROM good GROUP BY type
UNION ALL SELECT CASE row_hash % 50 WHEN 0 THEN 'start or end without a time and offset' WHEN 1 THEN 'unknown kind riddle' ELSE 'not a JSON object of the known types' END, 2 * count(*) FROM rec WHERE row_hash % 50 <= 2 GROUP BY 1""")
def import_deltas(t: Tables) -> DataFrame:
    """SRC-15..18, SNK-05, SNK-06, and the stream: lines that land, land again, and are counted once; bad ones are set aside each time."""
    spark, folder = t.spark, workspace(t.spark, "deltas")
    start, odd = wire(F.col("start_ts").cast("timestamp")), F.col("row_hash") % 50
    line = F.to_json(F.struct(
        F.when(odd == 1, "riddle").otherwise("record").alias("kind"), joined(ids.QUANTITY, ids.lookup(METRICS, F.col("type"))).alias("raw_type"), "source_name", "unit", "value",
        F.when(odd == 0, F.substring(start, 1, 19)).otherwise(start).alias("start"), start.alias("end"),
    ))
    lines = t.rec.select(F.when(odd == 2, F.lit("{broken")).otherwise(line).alias("value"))
    store = Store(spark, f"{folder}/store")
    for _ in range(2):
        lines.write.mode("append").option("compression", "gzip").text(f"{folder}/landing")
        delta.start(spark, f"{folder}/landing", store, f"{folder}/checkpoint").awaitTermination()
    rejected = spark.read.parquet(store.path("rejected")).groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return store.read("records").groupBy(F.col("type").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(rejected)


@query("wire_identity", f"SELECT row_hash AS event, {identity_sql()} AS row_hash FROM rec")
def wire_identity(t: Tables) -> DataFrame:
    """SRC-16, SC-12: a sample keeps its identity on either way in."""
    from .sources.identity import record_hash

    start = wire(F.col("start_ts").cast("timestamp"))
    rows = t.rec.select("row_hash", F.struct(
        F.lit("record").alias("kind"), joined(ids.QUANTITY, ids.lookup(METRICS, F.col("type"))).alias("raw_type"), "source_name", "unit", "value", start.alias("start"), start.alias("end"),
    ).alias("line"))
    parsed = rows.select("row_hash", F.from_json(F.to_json("line"), ndjson.LINE).alias("l")).select("row_hash", "l.*")
    type_, begin, end = ids.metric_type(F.col("raw_type")), tm.wired(F.col("start")), tm.wired(F.col("end"))
    return parsed.withColumns({"type": type_, "start_ts": begin, "end_ts": end}).select(F.col("row_hash").alias("event"), record_hash().alias("row_hash"))
