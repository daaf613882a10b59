"""Training load: each workout's impulse, days without a workout by their energy, weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import training as tr
from ..functions.times import week
from .rolling import all_days


def daily_load(workouts: DataFrame, records: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """(by, day, load, workouts, method). ``workouts`` as they are: copies of a session count each.

    A workout without impulse counts by its energy; a day without workout by its active
    energy above a quiet day's.
    """
    known = workouts.join(anchors, by)
    impulse = tr.trimp(F.coalesce("duration", F.lit(0.0)), F.col("avg_hr"), F.col("resting_hr"), F.col("hr_max"))
    each = known.select(
        *by, F.to_date("start_ts").alias("day"), F.coalesce(impulse, F.round(F.coalesce("energy", F.lit(0.0)) * tr.ENERGY_LOAD, 1)).alias("load"),
        F.when(impulse.isNull(), "energy_proxy").otherwise("trimp").alias("method"),
    )
    trained = each.groupBy(*by, "day").agg(
        F.round(F.sum("load"), 1).alias("load"), F.count(F.lit(1)).alias("workouts"),
        F.when(F.min("method") == F.max("method"), F.min("method")).otherwise("mixed").alias("method"),
    )
    energy = records.filter("type = 'active_energy'").groupBy(*by, F.to_date("start_ts").alias("day")).agg(F.sum("value").alias("kcal"))
    proxy = F.when(F.col("kcal") > tr.RESTING_KCAL, F.round((F.col("kcal") - tr.RESTING_KCAL) * tr.ENERGY_LOAD, 1))
    both = trained.join(energy, [*by, "day"], "full_outer").withColumn("quiet", F.col("workouts").isNull())
    return both.filter("NOT quiet OR kcal > " + str(tr.RESTING_KCAL)).select(
        *by, "day", F.when(F.col("quiet"), proxy).otherwise(F.col("load")).alias("load"), F.coalesce("workouts", F.lit(0)).alias("workouts"), F.coalesce("method", F.lit("energy_proxy")).alias("method")
    )


def data_start(workouts: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """(by, start): the first day with a workout or active energy."""
    days = records.filter("type = 'active_energy'").select(*by, "start_ts").unionByName(workouts.select(*by, "start_ts"))
    return days.groupBy(*by).agg(F.to_date(F.min("start_ts")).alias("start"))


def weekly_grid(runs: DataFrame, day_load: DataFrame, by: list[str]) -> DataFrame:
    """(by, week, km, n, minutes, load) of every week between the first and the last; empty weeks stay."""
    run = runs.groupBy(*by, week(F.col("day")).alias("week")).agg(
        F.sum(F.coalesce("distance", F.lit(0.0))).alias("km"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("minutes")
    )
    load = day_load.groupBy(*by, week(F.col("day")).alias("week")).agg(F.sum("load").alias("load"))
    both = run.join(load, [*by, "week"], "full_outer")
    full = all_days(both, by, "week", ["km", "n", "minutes", "load"], step=7)
    return full.select(*by, "week", F.round("km", 1).alias("km"), F.col("n").cast("long").alias("n"), F.round("minutes").alias("minutes"), F.round("load").alias("load"))


def owed_hours(load, minutes_to_morning):
    """Hours of recovery that the last session still asks for."""
    needed = F.least(F.lit(48.0), load * 0.25)
    return F.greatest(F.lit(0.0), needed - F.greatest(F.lit(0.0), minutes_to_morning / 60))
