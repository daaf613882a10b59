"""Checks of the store: how a workout's structure hangs together, and when a rebuild may stand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import utc_second
from ..operators.dedup import first_of, real_steps
from ..schema import TABLES
from ..sources.commits import Conflict
from ..sources.sink import MONTH, PACKED, TIMES, Store, hashed


def link_counts(events: DataFrame, workouts: DataFrame) -> DataFrame:
    """One row: steps in all, steps without a workout, and workouts with steps. ``workouts`` has workout_hash and row_hash."""
    marked = events.groupBy("workout_hash").agg(F.count(F.lit(1)).alias("steps"))
    known = workouts.groupBy("workout_hash").agg(F.countDistinct("row_hash").alias("rows"))
    both = marked.join(known, "workout_hash", "left")
    return both.agg(
        F.coalesce(F.sum("steps"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("rows").isNull(), F.col("steps"))), F.lit(0)).alias("orphans"), F.coalesce(F.sum("rows"), F.lit(0)).alias("linked")
    )


def link_report(events: DataFrame, workouts: DataFrame) -> dict[str, int]:
    """Steps in all, real ones, repetitions, orphans, workouts with steps, and sessions of intervals."""
    linked = link_counts(events, workouts.select(F.col("row_hash").alias("workout_hash"), "row_hash")).first()
    kinds = real_steps(events).agg(F.count(F.lit(1)).alias("deduped"), F.count(F.when(F.col("event_kind") == "activity", 1)).alias("reps")).first()
    return {
        "total": linked["total"],
        "deduped": kinds["deduped"],
        "reps": kinds["reps"],
        "orphans": linked["orphans"],
        "linked_workouts": linked["linked"],
        "interval_sessions": events.filter("event_kind = 'activity'").agg(F.countDistinct("workout_hash")).first()[0],
    }


def gates(before: dict[str, int], after: dict[str, int], rows_before: int, rows_after: int, distinct_hashes: int, max_collapse: float = 0.01) -> list[str]:
    """Why a rebuilt table may not replace the old one; nothing if it may."""
    found = []
    if rows_after != distinct_hashes:
        found.append(f"{rows_after} rows for {distinct_hashes} hashes")
    if after["orphans"] > before["orphans"]:
        found.append(f"orphans rose from {before['orphans']} to {after['orphans']}")
    if rows_before and (rows_before - rows_after) / rows_before > max_collapse:
        found.append(f"{rows_before - rows_after} of {rows_before} rows collapsed, more than {max_collapse:.2%}")
    return found


def rebuild(store: Store, name: str, max_collapse: float = 0.01) -> dict:
    """Gives a table's rows the hashes that their fields have now, and swaps it in if the gates let it pass.

    The new table is written beside the old one and checked: one row for each hash, no more steps without a
    workout, few enough rows that met under one hash. The swap is a commit that fails if the table has changed
    since it was read. A table that may not stand is deleted; readers see the old one until the commit.
    """
    state, own = store.state(), f"{name}/import=rebuilt-{uuid.uuid4().hex}"
    version, old = state["version"], store.read(name, state)
    linked = lambda events, workouts: link_counts(events, workouts.select(F.col("row_hash").alias("workout_hash"), "row_hash")).first().asDict()
    # of rows with one new hash the one with the smallest old hash; hashes travel as bytes, and an old one only where it differs
    now = hashed(name, old.withColumn("_old", F.col("row_hash")))
    before = F.when(F.col("_old") < F.col("row_hash"), 0).when(F.col("_old") == F.col("row_hash"), 1).otherwise(2).cast("byte")
    now = now.select("*", F.unhex("row_hash").alias("_new"), before.alias("_place_of_old")).withColumn("_old", F.nullif(F.col("_old"), F.col("row_hash"))).drop("row_hash")
    fresh = first_of(now, ["_new"], ["_place_of_old", "_old"]).withColumn("row_hash", F.lower(F.hex("_new"))).select(*TABLES[name].names)
    if name in TIMES:
        fresh = fresh.withColumn(MONTH, F.coalesce(F.substring(utc_second(F.col(TIMES[name])), 1, 7), F.lit("none")))
    fresh.write.partitionBy(*([MONTH] if name in TIMES else [])).parquet(store.path(own), compression=PACKED)
    new = store.spark.read.schema(fresh.schema).parquet(store.path(own))
    told = new.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.unhex("row_hash")).alias("hashes")).first()
    before = after = {"orphans": 0}
    if name == "workouts":
        events = store.read("workout_events", state)
        before, after = linked(events, old), linked(events, new)
    elif name == "workout_events":
        workouts = store.read("workouts", state)
        before, after = linked(old, workouts), linked(new, workouts)
    rows = store.rows(name, state)
    against = gates(before, after, rows, told["rows"], told["hashes"], max_collapse)
    try:
        if not against:
            store.replace(name, own, told["rows"], version)
    except Conflict as why:
        against.append(str(why))
    if against:
        store.files.delete(store.path(own))
    return {"before": rows, "after": told["rows"], "swapped": not against, "against": against}
