"""Tables and their types. Timestamps are UTC instants; days are derived at query time.

``subject_id`` names the athlete. Every window and every day key is partitioned by it,
so histories of many athletes are worked on side by side; with one athlete it is a
constant.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


RECORDS = table(
    ("row_hash", S), ("subject_id", S), ("type", S), ("raw_type", S), ("source_name", S), ("source_version", S), ("device", S), ("unit", S),
    ("value", D), ("value_str", S), ("start_ts", TS), ("end_ts", TS), ("created_ts", TS), ("source_priority", I),
)
WORKOUTS = table(
    ("row_hash", S), ("subject_id", S), ("type", S), ("raw_type", S), ("source_name", S), ("device", S), ("duration", D), ("duration_unit", S),
    ("distance", D), ("distance_unit", S), ("energy", D), ("energy_unit", S), ("avg_hr", D), ("max_hr", D), ("start_ts", TS), ("end_ts", TS),
)
WORKOUT_EVENTS = table(
    ("row_hash", S), ("workout_hash", S), ("subject_id", S), ("workout_type", S), ("workout_source_name", S), ("workout_start_ts", TS), ("workout_end_ts", TS),
    ("event_kind", S), ("event_type", S), ("raw_event_type", S), ("step_index", I), ("activity_uuid", S), ("step_key_path", S), ("step_block", I),
    ("step_repeat", I), ("step_slot", I), ("step_successful", B), ("start_ts", TS), ("end_ts", TS), ("duration", D), ("duration_unit", S),
    ("distance", D), ("distance_unit", S), ("energy", D), ("energy_unit", S), ("avg_hr", D), ("min_hr", D), ("max_hr", D), ("avg_speed", D),
    ("speed_unit", S), ("avg_power", D), ("power_unit", S), ("step_count", D), ("elevation_ascended", D), ("elevation_unit", S), ("stats_json", S),
)
SLEEP = table(("row_hash", S), ("subject_id", S), ("source_name", S), ("device", S), ("stage", S), ("raw_value", S), ("start_ts", TS), ("end_ts", TS))
ACTIVITY_SUMMARY = table(
    ("subject_id", S), ("date", S), ("active_energy", D), ("active_energy_goal", D), ("active_energy_unit", S), ("exercise_minutes", D),
    ("exercise_goal", D), ("stand_hours", D), ("stand_goal", D),
)
CLINICAL = table(("row_hash", S), ("subject_id", S), ("type", S), ("raw_type", S), ("identifier", S), ("source_name", S), ("fhir_version", S), ("received_ts", TS))
IMPORT_RUNS = table(("archive_name", S), ("imported_at", TS), ("records_total", L), ("workouts_total", L), ("sleep_total", L))

TABLES = {
    "records": RECORDS, "workouts": WORKOUTS, "workout_events": WORKOUT_EVENTS, "sleep": SLEEP,
    "activity_summary": ACTIVITY_SUMMARY, "clinical": CLINICAL, "import_runs": IMPORT_RUNS,
}
#: What makes a row of each table one row.
KEYS = {t: ["row_hash"] for t in TABLES} | {"activity_summary": ["subject_id", "date"], "import_runs": []}
