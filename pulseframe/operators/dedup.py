"""One row for each thing: ranking windows with deterministic order.

All keep the first row of each partition, which Spark prunes before the shuffle
(WindowGroupLimit), so a key with very many copies costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_place = 1").drop("_place")


def best_source(records: DataFrame, by: tuple = ("subject_id",), tie: str = "row_hash") -> DataFrame:
    """Of records of one type and window the one from the best source."""
    return first_of(records, [*by, "type", "start_ts", "end_ts"], [F.desc("source_priority"), F.asc_nulls_last("source_name"), tie])


def real_steps(events: DataFrame, by: tuple = ("subject_id",), tie: str = "row_hash") -> DataFrame:
    """One row for each step of a session, however often the session was exported.

    Events nested in an activity also need its uuid: one segment lies under several.
    """
    nested = F.when(F.col("event_kind") == "activity_event", F.col("activity_uuid"))
    place = ["workout_type", "workout_start_ts", "workout_end_ts", "event_kind", "raw_event_type", "step_index", "start_ts", "end_ts", "duration"]
    return first_of(events, [*by, *place, nested], [F.asc_nulls_last("workout_source_name"), tie])


def repetitions(events: DataFrame, by: tuple = ("subject_id", "workout_start_ts")) -> DataFrame:
    """The activities of a session, one for each uuid and index."""
    own = events.filter(F.col("event_kind") == "activity")
    return first_of(own, [*by, "activity_uuid", "step_index"], [F.asc_nulls_last("workout_source_name"), "row_hash"])


def real_workouts(workouts: DataFrame, by: tuple = ("subject_id",), tie: str = "row_hash") -> DataFrame:
    """One workout for each type and start minute."""
    return first_of(workouts, [*by, "type", F.date_trunc("minute", "start_ts")], ["start_ts", tie])


def collapsed(df: DataFrame, new_hash: Column, old: str = "row_hash") -> DataFrame:
    """Of rows with one new hash the one with the smallest old hash, under the new hash."""
    return first_of(df.withColumn("_new", new_hash), ["_new"], [old]).withColumn(old, F.col("_new")).drop("_new")


def collapse_profile(df: DataFrame, new_hash: Column, old: str = "row_hash", examples: int = 5) -> DataFrame:
    """The new hashes under which most rows meet, with two of their old hashes."""
    rows = df.groupBy(new_hash.alias("new_hash")).agg(F.count(F.lit(1)).alias("n"), F.min(old).alias("first_hash"), F.max(old).alias("last_hash"))
    return rows.filter("n > 1").orderBy(F.desc("n"), "new_hash").limit(examples)
