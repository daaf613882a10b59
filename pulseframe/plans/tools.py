"""The questions one asks of the store, as DataFrames; ``by`` names the athlete's column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import SUMMED
from ..functions.times import in_days, seconds, wake_day
from ..functions.training import named_bounds, percent_bounds
from ..operators import intervals, load, rolling, workouts, zones

SECTIONS = ("series", "zones", "reps", "decoupling", "splits")
ASLEEP = ("asleep", "core", "deep", "rem")
BY = ("subject_id",)


def metric_catalogue(records: DataFrame, by=BY) -> DataFrame:
    """Every metric with its readings, days and units."""
    return records.groupBy(*by, "type").agg(
        F.count(F.lit(1)).alias("records"), F.to_date(F.min("start_ts")).alias("first_day"), F.to_date(F.max("start_ts")).alias("last_day"),
        F.array_join(F.array_sort(F.collect_set("unit")), ", ").alias("units"),
    )


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each table has."""
    parts = [df.select(F.lit(name).alias("name")) for name, df in tables.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.agg(*(F.count(F.when(F.col("name") == n, 1)).alias(n) for n in tables))


def summary(records: DataFrame, by: list[str], grain: str = "day") -> DataFrame:
    """(by, period, samples, primary_value, min, max, avg, sum); additive metrics are summed, others averaged. ``by`` holds type."""
    grain = grain if grain in ("day", "week", "month") else "day"
    primary = F.when(F.first("type").isin(*SUMMED), F.sum("value")).otherwise(F.avg("value"))
    return records.groupBy(*by, F.to_date(F.date_trunc(grain, "start_ts")).alias("period")).agg(
        F.count(F.lit(1)).alias("samples"), primary.alias("primary_value"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg"), F.sum("value").alias("sum")
    )


def daily(records: DataFrame, metric: str, by=BY, first: str | None = None, last: str | None = None) -> DataFrame:
    """One metric by day."""
    own = records.filter((F.col("type") == metric) & in_days(F.col("start_ts"), first, last))
    value = F.sum("value") if metric in SUMMED else F.avg("value")
    return own.groupBy(*by, F.to_date("start_ts").alias("day")).agg(
        value.alias("value"), F.count(F.lit(1)).alias("samples"), F.min("value").alias("min"), F.max("value").alias("max"), F.min("unit").alias("unit")
    )


#: Days of a series that a tool shows at most.
SERIES_ROWS = 5000


def first_days(df: DataFrame, by=BY, day: str = "day", most: int = SERIES_ROWS) -> DataFrame:
    """A series from its first day on, as much as a tool shows."""
    return df.orderBy(day, *by).limit(most)


#: The tools that are one metric by day.
DAILY_TOOLS = {"steps": "step_count", "heart_rate": "heart_rate", "hrv": "hrv", "weight": "weight", "vo2max": "vo2max"}


def readings(records: DataFrame, metric: str = "heart_rate", first: str | None = None, last: str | None = None, limit: int = 2000) -> tuple[list, bool]:
    """The first readings in order of time, 20,000 at most, and whether there are more."""
    limit = max(1, min(int(limit), 20_000))
    own = records.filter((F.col("type") == metric) & in_days(F.col("start_ts"), first, last))
    rows = own.orderBy("start_ts", "row_hash").limit(limit + 1).select("start_ts", F.round("value", 0).alias("bpm"), "source_name").collect()
    return rows[:limit], len(rows) > limit


def stage_hours(sleep: DataFrame, by=BY, first: str | None = None, last: str | None = None) -> DataFrame:
    """(by, night, stage, hours), a night named by the day one wakes on. Overlaps count twice."""
    night = wake_day(F.col("start_ts"))
    own = sleep
    if first is not None:
        own = own.filter(night >= F.lit(first).cast("date"))
    if last is not None:
        own = own.filter(night <= F.lit(last).cast("date"))
    length = F.sum(seconds(F.col("end_ts")) - seconds(F.col("start_ts")))
    return own.groupBy(*by, night.alias("night"), "stage").agg(F.round(length / 3600, 2).alias("hours"))


def sleep_nights(sleep: DataFrame, by=BY, first: str | None = None, last: str | None = None) -> DataFrame:
    """(by, night, stages as a map, hours_asleep)."""
    rows = stage_hours(sleep, by, first, last)
    asleep = F.sum(F.when(F.col("stage").isin(*ASLEEP), F.col("hours")).otherwise(0.0))
    return rows.groupBy(*by, "night").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "hours")))).alias("stages"), asleep.alias("hours_asleep"))


def workout_list(table: DataFrame, first: str | None = None, last: str | None = None, kind: str | None = None, limit: int = 1000) -> DataFrame:
    own = table.filter(in_days(F.col("start_ts"), first, last))
    if kind:
        own = own.filter(F.col("type").ilike(f"%{kind}%"))
    rounded = {"duration": 1, "distance": 2, "energy": 0, "avg_hr": 0, "max_hr": 0}
    return own.orderBy(F.desc("start_ts"), "row_hash").limit(limit).withColumns({c: F.round(c, n) for c, n in rounded.items()})


def sections(wanted) -> tuple[str, ...]:
    """Names from a list or text; all by default, ValueError for an unknown one."""
    names = wanted.replace(",", " ").split() if isinstance(wanted, str) else list(wanted or ())
    names = [n.strip().lower() for n in names]
    if not names or "all" in names:
        return SECTIONS
    if unknown := [n for n in names if n not in SECTIONS]:
        raise ValueError(f"unknown sections: {', '.join(unknown)}; there are {', '.join(SECTIONS)}")
    return tuple(n for n in SECTIONS if n in names)


def workout_details(chosen: DataFrame, records: DataFrame, events: DataFrame, hr_max: float = 190.0, width: int = 30, include=None, named: str | None = None, by=BY) -> dict[str, DataFrame]:
    """The sections wanted, for all chosen workouts at once, keyed by their row_hash. Nothing is computed before it is read."""
    by = list(by)
    spans = chosen.select(*by, F.col("row_hash").alias("workout"), F.col("start_ts").alias("ws"), F.col("end_ts").alias("we"))
    inside = intervals.points_in(records, spans, by, "start_ts", "ws", "we", True)
    key, out = ["workout"], {}
    want = sections(include)
    bounds = named_bounds(named)
    if "series" in want:
        out["series"] = workouts.series(inside, key, "ws", width)
    # workouts of one athlete and span have the same samples: zones are told once and given to each
    spell = [*by, "ws", "we"]
    alike = spans.select(*spell).distinct()
    each = lambda told: told.join(spans, spell).drop(*spell)
    if "zones" in want:
        of = {"percent": percent_bounds(hr_max), "training": bounds}
        found = zones.zones_of_spans(records.filter("type = 'heart_rate'"), alike, by, "ws", "we", of)
        out["zones"] = each(found).select(*key, "model", "zone", "seconds", "minutes", "share")
    if {"reps", "decoupling"} & set(want):
        from ..operators.dedup import repetitions

        steps = repetitions(events).join(spans.select(*by, "workout", F.col("ws").alias("workout_start_ts")), [*by, "workout_start_ts"])
        reps = workouts.repetition_table(steps, key, bounds)
        told = workouts.work_summary(reps, key)
        if "reps" in want:
            out |= {"reps": reps, "work": told}
        if "decoupling" in want:
            # drift says nothing about a session of intervals
            steady = inside.join(told.filter("interval_structure").select(*key), key, "left_anti")
            out["decoupling"] = workouts.decoupling(steady, key, "ws", "we")
    if "splits" in want:
        # the running distance takes all samples of an instant at once, so they are one
        moved = records.filter("type = 'distance_walking_running'").groupBy(*by, "start_ts").agg(F.sum("value").alias("value"))
        out["splits"] = workouts.splits_of_spans(moved, spans, by, key, "ws", "we")
    return out


def hr_zones(records: DataFrame, table: DataFrame, hr_max: float, first: str | None = None, last: str | None = None, scope: str = "workouts", named: str | None = None, by=BY) -> DataFrame:
    by = list(by)
    own = records.filter((F.col("type") == "heart_rate") & in_days(F.col("start_ts"), first, last))
    if scope == "workouts":
        spans = table.select(*by, F.col("start_ts").alias("ws"), F.col("end_ts").alias("we"))
        own = intervals.points_covered(own, spans, by, "start_ts", "ws", "we")
    return zones.time_in_zones(own, by, {"percent": percent_bounds(hr_max), "training": named_bounds(named)})


def training_load(table: DataFrame, records: DataFrame, anchors: DataFrame, first: str | None = None, last: str | None = None, by=BY) -> dict[str, DataFrame]:
    """Daily load and workload ratio; the ratio looks back before ``first``."""
    by = list(by)
    every = load.daily_load(table, records, anchors, by)
    series = rolling.acwr(rolling.all_days(every, by, "day", ["load"]), by, since=load.data_start(table, records, by))
    shown = F.lit(True)
    if first is not None:
        shown = shown & (F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        shown = shown & (F.col("day") <= F.lit(last).cast("date"))
    return {"daily": every.filter(shown), "acwr": series.filter(shown)}


def sync_status(tables: dict[str, DataFrame], limit: int = 60) -> dict[str, DataFrame]:
    """Rows by table, the newest sample of each metric, and the last delta import."""
    limit = max(1, min(int(limit), 500))
    newest = tables["records"].groupBy("type").agg(F.max("start_ts").alias("newest"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("newest"), "type").limit(limit)
    imports = tables["import_runs"].filter(F.col("archive_name").startswith("delta")).orderBy(F.desc("imported_at")).limit(1)
    return {"counts": counts({k: v for k, v in tables.items() if k != "import_runs"}), "latest": newest, "last_import": imports}
