"""Row identity: an MD5 of what makes a row that row.

Instants count to the second in UTC, numbers to six significant digits, and a missing
part as empty text, so one sample has one hash from every export, on every machine, in
every session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.times import utc_second


def part(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def value_part(value: str = "value", text: str = "value_str") -> Column:
    """A quantity by its number, a category by its text."""
    return F.when(F.col(value).isNull(), part(F.col(text))).otherwise(F.format_string("%.5e", F.col(value)))


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(part(p) for p in parts)))


def record_hash() -> Column:
    return digest(F.col("type"), F.col("source_name"), utc_second(F.col("start_ts")), utc_second(F.col("end_ts")), F.col("unit"), value_part())


def workout_hash(kind: str = "type", source: str = "source_name", start: str = "start_ts", end: str = "end_ts") -> Column:
    """Also of a workout's events, over the workout's fields that they repeat: that is their link."""
    return digest(F.col(kind), F.col(source), utc_second(F.col(start)), utc_second(F.col(end)))


def parent_hash() -> Column:
    return workout_hash("workout_type", "workout_source_name", "workout_start_ts", "workout_end_ts")


def event_hash() -> Column:
    return digest(
        parent_hash(), F.col("event_kind"), F.col("raw_event_type"), F.col("activity_uuid"), F.col("step_index").cast("string"),
        utc_second(F.col("start_ts")), utc_second(F.col("end_ts")), F.when(F.col("duration").isNotNull(), F.format_string("%.5e", F.col("duration"))),
    )


def sleep_hash() -> Column:
    return digest(F.col("source_name"), F.col("raw_value"), utc_second(F.col("start_ts")), utc_second(F.col("end_ts")))


def clinical_hash() -> Column:
    return digest(F.col("type"), F.col("identifier"), F.col("source_name"))


HASHES = {"records": record_hash, "workouts": workout_hash, "workout_events": event_hash, "sleep": sleep_hash, "clinical": clinical_hash}
