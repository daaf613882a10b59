"""Incremental deltas: gzip NDJSON, one object a line, told apart by ``kind``.

A line becomes the same element that the XML export has and goes through the same
expressions, so a sample has one identity whichever way it came. Timestamps need an
offset and count to the second; a line that can't be read, has no known kind or lacks
what its kind requires is set aside with its reason, and the rest goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as ids
from ..functions.times import wired
from . import xml

S, D, I = T.StringType(), T.DoubleType(), T.IntegerType()
STAT = T.StructType([T.StructField(n, S) for n in ("raw_type", "start", "end")] + [T.StructField(n, D) for n in ("sum", "average", "minimum", "maximum")] + [T.StructField("unit", S)])
LINE = T.StructType(
    [T.StructField(n, S) for n in ("kind", "raw_type", "source_name", "source_version", "device", "unit")]
    + [T.StructField("value", D)]
    + [T.StructField(n, S) for n in ("value_str", "raw_value", "start", "end", "created")]
    + [T.StructField("duration", D), T.StructField("duration_unit", S), T.StructField("distance", D), T.StructField("distance_unit", S)]
    + [T.StructField("energy", D), T.StructField("energy_unit", S), T.StructField("avg_hr", D), T.StructField("max_hr", D), T.StructField("hr_unit", S)]
    + [T.StructField("workout", T.StructType([T.StructField(n, S) for n in ("raw_type", "source_name", "start", "end")]))]
    + [T.StructField(n, S) for n in ("raw_event_type", "date", "activity_uuid")]
    + [T.StructField("step_index", I), T.StructField("metadata", T.MapType(S, S)), T.StructField("statistics", T.ArrayType(STAT)), T.StructField("_corrupt", S)]
)
KINDS = ("record", "sleep", "workout", "workout_activity", "workout_event")
IGNORED = ("activity_summary", "clinical", "workout_route")


def options(reader):
    return reader.schema(LINE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return options(spark.read).json(path)


def fault() -> Column:
    """Why a line can't be taken; null if it can."""
    start, end = wired(F.col("start")), wired(F.col("end"))
    no_parent = F.col("workout").isNull() | F.col("workout.raw_type").isNull() | wired(F.col("workout.start")).isNull()
    kind = F.col("kind")
    return (
        F.when(F.col("_corrupt").isNotNull(), "not a JSON object of the known types")
        .when(kind.isNull(), "no kind")
        .when(~kind.isin(*KINDS, *IGNORED), F.concat(F.lit("unknown kind "), kind))
        .when(kind.isin(*IGNORED), F.lit(None))
        .when(kind.isin("record", "workout") & (F.coalesce("raw_type", F.lit("")) == ""), "no raw_type")
        .when(kind.isin("record", "workout", "sleep", "workout_activity") & (start.isNull() | end.isNull()), "start or end without a time and offset")
        .when((kind == "workout_event") & wired(F.coalesce("date", "start")).isNull(), "date without a time and offset")
        .when(kind.isin("workout_activity", "workout_event") & no_parent, "no workout")
        .when(kind.isin("workout_activity", "workout_event") & F.col("step_index").isNull(), "no step_index")
    )


def rejected(lines: DataFrame) -> DataFrame:
    """(kind, reason, line) of lines that are set aside."""
    return lines.withColumn("reason", fault()).filter("reason IS NOT NULL").select("kind", "reason", F.col("_corrupt").alias("line"))


def records(lines: DataFrame) -> DataFrame:
    out = lines.filter("kind = 'record'").select(
        ids.metric_type(F.col("raw_type")).alias("type"), "raw_type", "source_name", "source_version", "device", "unit",
        F.coalesce("value", ids.number(F.col("value_str"))).alias("value"), "value_str", wired(F.col("start")).alias("start_ts"), wired(F.col("end")).alias("end_ts"), wired(F.col("created")).alias("created_ts"),
    )
    return out.withColumn("source_priority", ids.source_priority(F.col("source_name")))


def sleep(lines: DataFrame) -> DataFrame:
    own = lines.filter("kind = 'sleep'").withColumn("raw", F.coalesce(F.nullif("raw_value", F.lit("")), "value_str"))
    stated = own.select("source_name", "device", ids.sleep_stage(F.col("raw")).alias("stage"), F.col("raw").alias("raw_value"), wired(F.col("start")).alias("start_ts"), wired(F.col("end")).alias("end_ts"))
    return stated.unionByName(xml.sleep(records(lines)))


def workouts(lines: DataFrame) -> DataFrame:
    nonzero = lambda c: F.nullif(F.col(c), F.lit(0.0)).alias(c)
    return lines.filter("kind = 'workout'").select(
        ids.metric_type(F.col("raw_type")).alias("type"), "raw_type", "source_name", "device", "duration", "duration_unit", "distance", "distance_unit", "energy", "energy_unit",
        nonzero("avg_hr"), nonzero("max_hr"), wired(F.col("start")).alias("start_ts"), wired(F.col("end")).alias("end_ts"),
    )


PARENT = ["workout_type", "workout_source_name", "workout_start_ts", "workout_end_ts"]


def with_parent(lines: DataFrame) -> DataFrame:
    return lines.select(
        "*", ids.metric_type(F.col("workout.raw_type")).alias("workout_type"), F.col("workout.source_name").alias("workout_source_name"),
        wired(F.col("workout.start")).alias("workout_start_ts"), wired(F.col("workout.end")).alias("workout_end_ts"),
    )


def as_text(value: Column) -> Column:
    """A number as the export writes it: whole numbers without a point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def steps(lines: DataFrame) -> DataFrame:
    own = with_parent(lines)
    statistic = lambda s: F.struct(
        s.raw_type.alias("_type"), s.start.alias("_startDate"), s.end.alias("_endDate"), as_text(s.average).alias("_average"), as_text(s.minimum).alias("_minimum"),
        as_text(s.maximum).alias("_maximum"), as_text(s["sum"]).alias("_sum"), s.unit.alias("_unit"),
    )
    entries = F.transform(F.map_entries("metadata"), lambda e: F.struct(e.key.alias("_key"), e.value.alias("_value")))
    activity = F.struct(
        F.col("activity_uuid").alias("_uuid"), second("start").alias("_startDate"), second("end").alias("_endDate"), as_text(F.col("duration")).alias("_duration"), F.col("duration_unit").alias("_durationUnit"),
        F.transform("statistics", statistic).alias("WorkoutStatistics"), entries.alias("MetadataEntry"),
    )
    activities = own.filter("kind = 'workout_activity'").select(*PARENT, "step_index", activity.alias("a"))
    event = F.struct(F.col("raw_event_type").alias("_type"), second("date", "start").alias("_date"), as_text(F.col("duration")).alias("_duration"), F.col("duration_unit").alias("_durationUnit"))
    kind = F.when(F.coalesce("activity_uuid", F.lit("")) == "", "event").otherwise("activity_event")
    events = own.filter("kind = 'workout_event'").select(*PARENT, "step_index", "activity_uuid", kind.alias("event_kind"), event.alias("e"))
    return xml.filled(xml.event_rows(events, PARENT)).unionByName(xml.filled(xml.activity_rows(activities, PARENT)))


def second(*columns: str) -> Column:
    """An instant as the export writes it, in UTC."""
    from ..functions.times import utc_second

    return F.concat(utc_second(wired(F.coalesce(*(F.col(c) for c in columns)))), F.lit(" +0000"))


def delta_frames(lines: DataFrame) -> dict[str, DataFrame]:
    """The tables of a batch's good lines."""
    good = lines.filter(fault().isNull())
    return {"records": records(good), "sleep": sleep(good), "workouts": workouts(good), "workout_events": steps(good)}


