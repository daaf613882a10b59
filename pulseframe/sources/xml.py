"""The XML export: one reader for each kind of element, always with a schema.

Attributes come as text and are parsed by Column expressions, shared with the delta
source, so both give the same rows. A truncated file gives the elements that it holds
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as ids
from ..functions.times import exported
from ..operators.baselines import let
from ..schema import TABLES
from .archive import read_archive

# Statistics that count as distance.
DISTANCES = ("DistanceWalkingRunning", "DistanceCycling", "DistanceSwimming", "DistanceDownhillSnowSports")
# Keys of a repetition's metadata.
KEY_PATH, SUCCESS, ELEVATION = "WOIntervalStepKeyPath", "WOIntervalStepSuccessful", "HKElevationAscended"


def attributes(*names: str) -> list[T.StructField]:
    return [T.StructField(f"_{n}", T.StringType()) for n in names]


def many(name: str, fields: list[T.StructField]) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StructType(fields)))


STATISTIC = attributes("type", "startDate", "endDate", "average", "minimum", "maximum", "sum", "unit")
WORKOUT_EVENT = attributes("type", "date", "duration", "durationUnit")
ACTIVITY = [
    *attributes("uuid", "startDate", "endDate", "duration", "durationUnit"),
    many("WorkoutEvent", WORKOUT_EVENT), many("WorkoutStatistics", STATISTIC), many("MetadataEntry", attributes("key", "value")),
]
ELEMENTS = {
    "Record": T.StructType(attributes("type", "sourceName", "sourceVersion", "device", "unit", "value", "startDate", "endDate", "creationDate")),
    "Workout": T.StructType(
        [
            *attributes("workoutActivityType", "sourceName", "device", "duration", "durationUnit", "totalDistance", "totalDistanceUnit", "totalEnergyBurned", "totalEnergyBurnedUnit", "startDate", "endDate"),
            many("WorkoutStatistics", STATISTIC), many("WorkoutEvent", WORKOUT_EVENT), many("WorkoutActivity", ACTIVITY),
        ]
    ),
    "ActivitySummary": T.StructType(attributes("dateComponents", "activeEnergyBurned", "activeEnergyBurnedGoal", "activeEnergyBurnedUnit", "appleExerciseTime", "appleExerciseTimeGoal", "appleStandHours", "appleStandHoursGoal")),
    "ClinicalRecord": T.StructType(attributes("type", "identifier", "sourceName", "fhirVersion", "receivedDate")),
}


def read_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements of one kind from XML files."""
    reader = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("ignoreSurroundingSpaces", "false")
    return reader.option("mode", "PERMISSIVE").schema(ELEMENTS[tag]).load(path)


def elements_of(raw: DataFrame, tag: str) -> DataFrame:
    """Elements of one kind from (tag, xml) rows of an archive."""
    own = raw.filter(F.col("tag") == tag)
    parsed = own.select(F.from_xml("xml", ELEMENTS[tag], {"rowTag": tag, "attributePrefix": "_", "ignoreSurroundingSpaces": "false"}).alias("e"))
    return parsed.filter(F.col("e").isNotNull()).select("e.*")


def records(elements: DataFrame) -> DataFrame:
    out = elements.select(
        ids.metric_type(F.col("_type")).alias("type"), F.col("_type").alias("raw_type"), F.col("_sourceName").alias("source_name"), F.col("_sourceVersion").alias("source_version"),
        F.col("_device").alias("device"), F.col("_unit").alias("unit"), ids.number(F.col("_value")).alias("value"), F.col("_value").alias("value_str"),
        exported(F.col("_startDate")).alias("start_ts"), exported(F.col("_endDate")).alias("end_ts"), exported(F.col("_creationDate")).alias("created_ts"),
    )
    return out.withColumn("source_priority", ids.source_priority(F.col("source_name")))


def sleep(rows: DataFrame) -> DataFrame:
    """Sleep segments of records, which stay records too."""
    own = rows.filter("type = 'sleep_analysis'")
    return own.select("source_name", "device", ids.sleep_stage(F.col("value_str")).alias("stage"), F.col("value_str").alias("raw_value"), "start_ts", "end_ts")


def statistic(stats: Column, kinds: tuple[str, ...], field: str) -> Column:
    """The last number that a statistic of these kinds has in the field."""
    names = [ids.QUANTITY + k for k in kinds]
    found = F.transform(F.filter(stats, lambda s: s["_type"].isin(*names)), lambda s: ids.number(s[f"_{field}"]))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))


def unit_of(stats: Column, kinds: tuple[str, ...], field: str | None) -> Column:
    names = [ids.QUANTITY + k for k in kinds]
    own = F.filter(stats, lambda s: s["_type"].isin(*names) & (ids.number(s[f"_{field}"]).isNotNull() if field else F.lit(True)))
    return F.try_element_at(F.filter(F.transform(own, lambda s: s["_unit"]), lambda x: x.isNotNull()), F.lit(-1))


def workouts(elements: DataFrame) -> DataFrame:
    """Workouts; a statistic overrides the attribute, a heart rate of 0 doesn't."""
    stats = F.coalesce("WorkoutStatistics", F.expr("array()").cast(ELEMENTS["Workout"]["WorkoutStatistics"].dataType))
    energy = ("ActiveEnergyBurned",)

    def rate(field):
        names = F.transform(F.filter(stats, lambda s: s["_type"] == ids.QUANTITY + "HeartRate"), lambda s: F.nullif(ids.number(s[f"_{field}"]), F.lit(0.0)))
        return F.try_element_at(F.filter(names, lambda x: x.isNotNull()), F.lit(-1))

    return elements.select(
        ids.metric_type(F.col("_workoutActivityType")).alias("type"), F.col("_workoutActivityType").alias("raw_type"), F.col("_sourceName").alias("source_name"), F.col("_device").alias("device"),
        ids.number(F.col("_duration")).alias("duration"), F.col("_durationUnit").alias("duration_unit"),
        F.coalesce(statistic(stats, DISTANCES, "sum"), ids.number(F.col("_totalDistance"))).alias("distance"), F.coalesce(unit_of(stats, DISTANCES, "sum"), F.col("_totalDistanceUnit")).alias("distance_unit"),
        F.coalesce(statistic(stats, energy, "sum"), ids.number(F.col("_totalEnergyBurned"))).alias("energy"), F.coalesce(unit_of(stats, energy, "sum"), F.col("_totalEnergyBurnedUnit")).alias("energy_unit"),
        rate("average").alias("avg_hr"), rate("maximum").alias("max_hr"), exported(F.col("_startDate")).alias("start_ts"), exported(F.col("_endDate")).alias("end_ts"),
    )


def statistics_json(stats: Column) -> Column:
    """All statistics as JSON, names and fields in order; null without any."""
    fields = sorted(f.name for f in STATISTIC if f.name != "_type")
    entries = F.transform(stats, lambda s: F.struct(F.regexp_replace(F.coalesce(s["_type"], F.lit("")), f"^{ids.QUANTITY}", "").alias("key"), F.struct(*(s[f].alias(f[1:]) for f in fields)).alias("value")))
    # the last of statistics of one name stands; to_json leaves out fields that are null
    last = lambda all_, k: F.element_at(F.filter(all_, lambda e: e["key"] == k), -1)
    ordered = let(entries, lambda all_: F.transform(F.array_sort(F.array_distinct(F.transform(all_, lambda e: e["key"]))), lambda k: last(all_, k)))
    return F.when(F.size(stats) > 0, F.to_json(F.map_from_entries(ordered)))


def steps(elements: DataFrame) -> DataFrame:
    """The structure of workouts: their events, their activities, and the events within those."""
    base = elements.select(
        ids.metric_type(F.col("_workoutActivityType")).alias("workout_type"), F.col("_sourceName").alias("workout_source_name"),
        exported(F.col("_startDate")).alias("workout_start_ts"), exported(F.col("_endDate")).alias("workout_end_ts"), "WorkoutEvent", "WorkoutActivity",
    )
    parent = ["workout_type", "workout_source_name", "workout_start_ts", "workout_end_ts"]
    events = base.select(*parent, F.posexplode("WorkoutEvent").alias("step_index", "e"), F.lit(None).cast("string").alias("activity_uuid"), F.lit("event").alias("event_kind"))
    activities = base.select(*parent, F.posexplode("WorkoutActivity").alias("step_index", "a"))
    nested = activities.select(*parent, F.posexplode("a.WorkoutEvent").alias("step_index", "e"), F.col("a._uuid").alias("activity_uuid"), F.lit("activity_event").alias("event_kind"))
    return filled(event_rows(events.unionByName(nested), parent)).unionByName(filled(activity_rows(activities, parent)))


def filled(df: DataFrame) -> DataFrame:
    """All columns of a step; what a kind lacks is null."""
    given = {"row_hash", "workout_hash", "subject_id"}
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["workout_events"].fields if f.name not in given))


def event_rows(df: DataFrame, parent: list[str]) -> DataFrame:
    start, duration = exported(F.col("e._date")), ids.number(F.col("e._duration"))
    until = F.when(F.col("e._durationUnit") == "min", F.timestamp_micros((F.unix_micros(start) + F.round(duration * 6e7)).cast("long")))
    return df.select(
        *parent, "event_kind", ids.event_type(F.col("e._type")).alias("event_type"), F.col("e._type").alias("raw_event_type"), "step_index", "activity_uuid",
        start.alias("start_ts"), until.alias("end_ts"), duration.alias("duration"), F.col("e._durationUnit").alias("duration_unit"),
    )


def activity_rows(df: DataFrame, parent: list[str]) -> DataFrame:
    meta = F.map_from_entries(F.transform(F.coalesce("a.MetadataEntry", F.expr("array()").cast(T.ArrayType(T.StructType(attributes("key", "value"))))), lambda m: F.struct(m["_key"].alias("k"), m["_value"].alias("v"))))
    stats = F.coalesce("a.WorkoutStatistics", F.expr("array()").cast(T.ArrayType(T.StructType(STATISTIC))))
    path = F.try_element_at(meta, F.lit(KEY_PATH))
    ascent, ascent_unit = ids.quantity(F.try_element_at(meta, F.lit(ELEVATION)))
    one = lambda kind, field: statistic(stats, (kind,), field)
    return df.select(
        *parent, F.lit("activity").alias("event_kind"), "step_index", F.col("a._uuid").alias("activity_uuid"), path.alias("step_key_path"),
        *(ids.key_path(path, i).alias(n) for i, n in enumerate(("step_block", "step_repeat", "step_slot"))), ids.success(F.try_element_at(meta, F.lit(SUCCESS))).alias("step_successful"),
        exported(F.col("a._startDate")).alias("start_ts"), exported(F.col("a._endDate")).alias("end_ts"), ids.number(F.col("a._duration")).alias("duration"), F.col("a._durationUnit").alias("duration_unit"),
        statistic(stats, DISTANCES, "sum").alias("distance"), unit_of(stats, DISTANCES, None).alias("distance_unit"), one("ActiveEnergyBurned", "sum").alias("energy"), unit_of(stats, ("ActiveEnergyBurned",), None).alias("energy_unit"),
        one("HeartRate", "average").alias("avg_hr"), one("HeartRate", "minimum").alias("min_hr"), one("HeartRate", "maximum").alias("max_hr"),
        one("RunningSpeed", "average").alias("avg_speed"), unit_of(stats, ("RunningSpeed",), None).alias("speed_unit"), one("RunningPower", "average").alias("avg_power"), unit_of(stats, ("RunningPower",), None).alias("power_unit"),
        one("StepCount", "sum").alias("step_count"), ascent.alias("elevation_ascended"), ascent_unit.alias("elevation_unit"), statistics_json(stats).alias("stats_json"),
    )


def activity_summaries(elements: DataFrame) -> DataFrame:
    number = lambda c: ids.number(F.col(c))
    return elements.select(
        F.col("_dateComponents").alias("date"), number("_activeEnergyBurned").alias("active_energy"), number("_activeEnergyBurnedGoal").alias("active_energy_goal"), F.col("_activeEnergyBurnedUnit").alias("active_energy_unit"),
        number("_appleExerciseTime").alias("exercise_minutes"), number("_appleExerciseTimeGoal").alias("exercise_goal"), number("_appleStandHours").alias("stand_hours"), number("_appleStandHoursGoal").alias("stand_goal"),
    ).filter("date IS NOT NULL")


def clinical(elements: DataFrame) -> DataFrame:
    return elements.select(
        ids.metric_type(F.col("_type")).alias("type"), F.col("_type").alias("raw_type"), F.col("_identifier").alias("identifier"), F.col("_sourceName").alias("source_name"),
        F.col("_fhirVersion").alias("fhir_version"), exported(F.col("_receivedDate")).alias("received_ts"),
    )


#: The element that each table's rows come from.
SOURCES = {"records": "Record", "sleep": "Record", "workouts": "Workout", "workout_events": "Workout", "activity_summary": "ActivitySummary", "clinical": "ClinicalRecord"}


def frames(of, kinds=tuple(SOURCES)) -> dict[str, DataFrame]:
    """The tables named in ``kinds`` from ``of(tag)``, the elements of a kind."""
    table = {"records": records, "sleep": lambda e: sleep(records(e)), "workouts": workouts, "workout_events": steps, "activity_summary": activity_summaries, "clinical": clinical}
    raw = {tag: of(tag) for tag in dict.fromkeys(SOURCES[k] for k in kinds)}
    return {k: table[k](raw[SOURCES[k]]) for k in kinds}


def kept_elements(spark: SparkSession, path: str, folder: str, tags: list[str]):
    """``of`` for ``frames``: the export is read and its elements parsed once, into ``folder``."""
    if path.lower().endswith(".zip"):
        raw = read_archive(spark, path, tags)
        own = {tag: F.when(F.col("tag") == tag, F.from_xml("xml", ELEMENTS[tag], {"rowTag": tag, "attributePrefix": "_", "ignoreSurroundingSpaces": "false"})) for tag in tags}
        raw.select("tag", *(c.alias(tag) for tag, c in own.items())).write.partitionBy("tag").parquet(folder)
        schema = T.StructType([T.StructField(tag, ELEMENTS[tag]) for tag in tags] + [T.StructField("tag", T.StringType())])
        return lambda tag: spark.read.schema(schema).parquet(folder).filter((F.col("tag") == tag) & F.col(tag).isNotNull()).select(f"{tag}.*")
    for tag in tags:
        read_elements(spark, path, tag).write.parquet(f"{folder}/{tag}")
    return lambda tag: spark.read.schema(ELEMENTS[tag]).parquet(f"{folder}/{tag}")


def export_frames(spark: SparkSession, path: str, kinds=tuple(SOURCES), folder: str | None = None) -> dict[str, DataFrame]:
    """The tables of XML files, or of a zip archive.

    Each table reads the export by itself when it is read; with ``folder``, elements are parsed now, once for all
    tables, and kept there.
    """
    tags = list(dict.fromkeys(SOURCES[k] for k in kinds))
    if folder is not None:
        return frames(kept_elements(spark, path, folder, tags), kinds)
    if path.lower().endswith(".zip"):
        raw = read_archive(spark, path, tags)
        return frames(lambda tag: elements_of(raw, tag), kinds)
    return frames(lambda tag: read_elements(spark, path, tag), kinds)


def workout_frames(spark: SparkSession, path: str, folder: str | None = None) -> dict[str, DataFrame]:
    """Workouts and their steps alone: other elements aren't parsed."""
    return export_frames(spark, path, ("workouts", "workout_events"), folder)
