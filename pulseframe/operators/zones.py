"""Heart-rate zones: anchors, and time weighted by the gap to the next sample."""

from __future__ import annotations

import json
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import training as tr
from ..functions.times import seconds
from .dedup import real_workouts
from .intervals import points_in


def gap_weights(samples: DataFrame, by: list[str], at: str = "start_ts", cap: int = 60, tie: str = "row_hash") -> DataFrame:
    """``samples`` with ``seconds`` to the next one, ``cap`` at most; the last weighs nothing.

    Samples are ordered within their day; a day's last one looks at the first of the athlete's next day, of
    which there is one row a day.
    """
    placed = samples.withColumn("_day", F.to_date(at))
    firsts = placed.groupBy(*by, "_day").agg(F.min(at).alias("_first"))
    later = firsts.select(*by, "_day", F.lead("_first").over(Window.partitionBy(*by).orderBy("_day")).alias("_later"))
    within = F.lead(at).over(Window.partitionBy(*by, "_day").orderBy(at, tie))
    following = F.coalesce("_within", "_later")
    found = placed.withColumn("_within", within).join(later, [*by, "_day"])
    return found.withColumn("seconds", F.least(F.coalesce(seconds(following) - seconds(F.col(at)), F.lit(0)), F.lit(cap))).drop("_day", "_within", "_later")


def time_in_zones(samples: DataFrame, by: list[str], models: dict[str, list[tuple[str, float]]], cap: int = 60, tie: str = "row_hash") -> DataFrame:
    """(by, model, zone, seconds, minutes, share), every zone of every model, from one pass over the samples."""
    weighted = gap_weights(samples, by, cap=cap, tie=tie).filter(F.col("value").isNotNull())
    marks = [F.struct(F.lit(m).alias("model"), tr.zone_of(F.col("value"), bounds).alias("zone")) for m, bounds in models.items()]
    spent = weighted.select(*by, "seconds", F.explode(F.array(*marks)).alias("mark")).groupBy(*by, "mark.model", "mark.zone").agg(F.sum("seconds").alias("seconds"))
    every = [F.struct(F.lit(m).alias("model"), F.lit(z).alias("zone")) for m, bounds in models.items() for z, _ in bounds]
    grid = spent.select(*by).distinct().select(*by, F.explode(F.array(*every)).alias("mark")).select(*by, "mark.model", "mark.zone")
    full = grid.join(spent, [*by, "model", "zone"], "left").withColumn("seconds", F.coalesce("seconds", F.lit(0)))
    total = F.sum("seconds").over(Window.partitionBy(*by, "model"))
    share = F.coalesce(F.round(F.try_divide(F.col("seconds"), total), 3), F.lit(0.0))
    return full.select(*by, "model", "zone", "seconds", F.round(F.col("seconds") / 60, 1).alias("minutes"), share.alias("share"))


def zones_of_spans(samples: DataFrame, spans: DataFrame, by: list[str], start: str, end: str, models: dict[str, list[tuple[str, float]]], cap: int = 60, tie: str = "row_hash") -> DataFrame:
    """``time_in_zones`` of every span (by, start, end; both ends included).

    A sample's gap to the next is the same in every span but for the span's last one, which weighs nothing. So gaps are
    taken once, an instant's samples are one row, and a span adds up its instants less the last, without sorting them.
    """
    weighted = gap_weights(samples, by, cap=cap, tie=tie)
    every = [(m, z, bounds) for m, bounds in models.items() for z, _ in bounds]
    spent = [F.coalesce(F.sum(F.when(tr.zone_of(F.col("value"), bounds) == z, F.col("seconds"))), F.lit(0)).alias(f"_z{i}") for i, (_, z, bounds) in enumerate(every)]
    instants = weighted.groupBy(*by, F.col("start_ts").alias("_at")).agg(F.count("value").alias("_known"), *spent)
    inside = points_in(instants, spans.select(*by, start, end), by, "_at", start, end, True)
    whole = [(F.sum(f"_z{i}") - F.max_by(f"_z{i}", "_at")).alias(f"_z{i}") for i in range(len(every))]
    told = inside.groupBy(*by, start, end).agg(F.sum("_known").alias("_known"), *whole).filter("_known > 0")
    total = {m: reduce(add, [F.col(f"_z{i}") for i, (own, _, _) in enumerate(every) if own == m]) for m in models}
    rows = [F.struct(F.lit(m).alias("model"), F.lit(z).alias("zone"), F.col(f"_z{i}").alias("seconds"), total[m].alias("total")) for i, (m, z, _) in enumerate(every)]
    out = told.select(*by, start, end, F.explode(F.array(*rows)).alias("_one")).select(*by, start, end, "_one.*")
    share = F.coalesce(F.round(F.try_divide(F.col("seconds"), F.col("total")), 3), F.lit(0.0))
    return out.select(*by, start, end, "model", "zone", "seconds", F.round(F.col("seconds") / 60, 1).alias("minutes"), share.alias("share"))


def zones_of_pairs(pairs: DataFrame, by: list[str], bounds: list[tuple[str, float]], bpm: str = "bpm", width: str = "seconds") -> DataFrame:
    """Time in zones from (bpm, seconds), such as the bins of a series."""
    known = pairs.filter(F.col(bpm).isNotNull())
    return known.groupBy(*by, tr.zone_of(F.col(bpm), bounds).alias("zone")).agg(F.sum(F.coalesce(F.col(width), F.lit(0))).alias("seconds"))


def functional_max(workouts: DataFrame, by: list[str], since: str | None = None, least: int = 4) -> DataFrame:
    """(by, hr_max, runs): the interpolated 95th percentile of the runs' maxima, one for each real run.

    Below ``least`` runs it is the largest of any workout.
    """
    runs = workouts.filter("type = 'running' AND max_hr IS NOT NULL")
    if since is not None:
        runs = runs.filter(F.col("start_ts") >= F.lit(since).cast("timestamp"))
    real = real_workouts(runs, tuple(by)).filter("max_hr <> 0").groupBy(*by).agg(F.percentile("max_hr", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("runs"))
    top = workouts.groupBy(*by).agg(F.round(F.max("max_hr")).alias("top"))
    value = F.when(F.col("runs") >= least, F.col("p95")).otherwise(F.coalesce(F.nullif(F.col("top"), F.lit(0.0)), F.lit(tr.HR_MAX)))
    return top.join(real, by, "left").select(*by, value.alias("hr_max"), F.coalesce("runs", F.lit(0)).alias("runs"))


def resting_rate(records: DataFrame, by: list[str], days: int = 90, share: float = 0.10) -> DataFrame:
    """(by, resting_hr): a low percentile of the last ``days`` days of readings, up to the newest one."""
    own = records.filter("type = 'resting_heart_rate'")
    newest = own.groupBy(*by).agg(F.max("start_ts").alias("_newest"))
    recent = own.join(newest, by).filter(F.col("start_ts") >= F.col("_newest") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(*by).agg(F.round(F.percentile("value", F.lit(share))).alias("resting_hr"))


def reference(path: str | None) -> dict:
    """The calibration file's values; nothing if it can't be read."""
    try:
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
    except (OSError, ValueError, TypeError):
        return {}
    return found if isinstance(found, dict) else {}


def anchors(workouts: DataFrame, records: DataFrame, by: list[str], hr_max: float | None = None, resting_hr: float | None = None, calibration: str | None = None, since: str | None = None) -> DataFrame:
    """(by, hr_max, resting_hr) by preference: given, calibrated, found in the data, default."""
    known = reference(calibration)
    hr_max = hr_max if hr_max is not None else tr.calibrated(known, ("hr_max", "hrmax", "functional_hr_max", "max_hr"), tr.HR_MAX_RANGE)
    resting_hr = resting_hr if resting_hr is not None else tr.calibrated(known, ("resting_hr", "rhr", "resting_heart_rate"), tr.RESTING_RANGE)
    who = workouts.select(*by).unionByName(records.select(*by)).distinct()
    out = who.join(functional_max(workouts, by, since).drop("runs"), by, "left") if hr_max is None else who.withColumn("hr_max", F.lit(float(hr_max)))
    out = out.join(resting_rate(records, by), by, "left") if resting_hr is None else out.withColumn("resting_hr", F.lit(float(resting_hr)))
    return out.fillna({"hr_max": tr.HR_MAX, "resting_hr": tr.RESTING_HR})
