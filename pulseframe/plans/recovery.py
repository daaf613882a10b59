"""Recovery and readiness of every night of every athlete, in one plan.

Each metric gives one value a night; a window over nights gathers the 28 before it as a
short array, and the rest is array arithmetic. To see one night, filter the result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as sc
from ..functions import training as tr
from ..functions.times import micros, minutes_past_18, seconds, wake_day
from ..operators import baselines as bl
from ..operators import intervals, load, rolling
from ..sources.workspace import kept

ASLEEP = ("asleep", "core", "deep", "rem")
# The records behind each sub-score.
METRICS = {"hrv": "hrv", "sleeping_hr": "heart_rate", "resp": "respiratory_rate", "temp": "sleeping_wrist_temperature"}

#: Rows of a night's samples and segments up to which sums in its windows add them one by one, as SQL's do.
NIGHT_ROWS = 50_000


def night_table(sleep: DataFrame, by: list[str]) -> DataFrame:
    """``sleep_inputs`` with each night's windows, from one pass over the segments, kept in a scratch table of a row a night.

    Its size is known before samples are joined with it, so these stay where they are unless nights are too many to broadcast.
    win_start, win_end: of all samples; staged: whether a segment has a stage; asleep_hours, asleep_from, asleep_to: of such segments,
    or of the generic ones of a night without.
    """
    start, end = F.col("start_ts"), F.col("end_ts")
    bed, asleep = F.col("stage").isin(*ASLEEP, "in_bed"), F.col("stage").isin(*ASLEEP)
    kinds = {"staged": asleep & (F.col("stage") != "asleep"), "generic": F.col("stage") == "asleep"}
    of = {n: (F.sum(F.when(k, seconds(end) - seconds(start))) / 3600, F.min(F.when(k, start)), F.max(F.when(k, end))) for n, k in kinds.items()}
    staged = F.max(F.when(asleep, kinds["staged"]))
    own = [F.when(staged, x).otherwise(y).alias(n) for n, x, y in zip(("asleep_hours", "asleep_from", "asleep_to"), of["staged"], of["generic"], strict=True)]
    nights = sleep.groupBy(*by, wake_day(start).alias("night")).agg(
        *(c.alias(n) for n, c in _inputs().items()), F.min(F.when(bed, start)).alias("win_start"), F.max(F.when(bed, end)).alias("win_end"), staged.alias("staged"), *own
    )
    return kept(nights, "nights")


def night_values(nights: DataFrame, records: DataFrame, by: list[str], metrics: dict[str, str]) -> DataFrame:
    """(by, night, a mean and a count <name>_n for each metric) between a night's first start and last end, from one range join with ``night_table``."""
    spans = nights.filter("win_start IS NOT NULL").select(*by, "night", "win_start", "win_end")
    points = records.filter(F.col("type").isin(*metrics.values())).select(*by, "start_ts", "type", "value")
    inside = intervals.points_in(points, spans, by, "start_ts", "win_start", "win_end", True)
    of = {name: F.when(F.col("type") == metric, F.col("value")) for name, metric in metrics.items()}
    return inside.groupBy(*by, "night").agg(*(F.avg(v).alias(n) for n, v in of.items()), *(F.count(v).alias(f"{n}_n") for n, v in of.items()))


def night_means(sleep: DataFrame, records: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, night, value, samples) of one metric; nights without samples stay."""
    nights = night_table(sleep, by)
    found = night_values(nights, records, by, {"value": metric})
    return nights.filter("win_start IS NOT NULL").select(*by, "night").join(found, [*by, "night"], "left").select(*by, "night", "value", F.coalesce("value_n", F.lit(0)).alias("samples"))


def sleeping_rate(sleep: DataFrame, records: DataFrame, by: list[str], window: int = 5, least_samples: int = 2, least_hours: float = 3.0, least_windows: int = 5, low: float = 0.05, nights: DataFrame | None = None) -> DataFrame:
    """(by, night, value, source, asleep_hours, valid_windows): the lowest sustained heart rate asleep.

    Of nights with stages: the least mean of ``window`` minutes with ``least_samples``
    samples, over samples in deep, core or REM sleep; a night too short or with too few
    windows has none. Of nights with generic sleep only: a low percentile. A night is of
    one kind, so both come from one range join and one pass over its samples.
    ``nights``: the ``night_table`` of the segments, if there is one already.
    """
    key = [*by, "night"]
    kind, night = [*key, "staged"], Window.partitionBy(*key, "staged")
    slept = (night_table(sleep, by) if nights is None else nights).filter("staged IS NOT NULL").select(*kind, "asleep_hours", "asleep_from", "asleep_to")
    points = records.filter("type = 'heart_rate'").select(*by, "start_ts", "value")
    parts = sleep.filter(F.col("stage").isin(*ASLEEP)).select(
        *by, wake_day(F.col("start_ts")).alias("night"), (F.col("stage") != "asleep").alias("staged"), F.col("start_ts").alias("seg_start"), F.col("end_ts").alias("seg_end")
    )
    near = intervals.points_in(points, slept.drop("asleep_hours"), by, "start_ts", "asleep_from", "asleep_to", False).drop("asleep_from", "asleep_to")
    # a night's samples and segments are shuffled once; all that follows is by night
    inside = intervals.covering(near, parts, kind, "start_ts", "seg_start", "seg_end")
    times = F.col("_times")
    # samples of one instant are one row, and one that several segments hold counts as often; of short nights, and of generic sleep, each is a row
    few = F.sum(times).over(night) <= NIGHT_ROWS
    alone = inside.withColumn("_few", few).withColumn("_alone", F.when(~F.col("staged") | F.col("_few"), F.monotonically_increasing_id()))
    sample = alone.groupBy(*kind, "start_ts", "_times", "_alone").agg(F.sum("value").alias("total"), F.count("value").alias("values"), F.count(F.lit(1)).alias("rows"))
    one = F.struct("total", "values", "rows")
    whole = F.struct((F.col("total") * times).alias("total"), (F.col("values") * times).alias("values"), (F.col("rows") * times).alias("rows"))
    each = F.when(~F.col("staged"), F.array(one)).when(F.col("_alone").isNotNull(), F.array_repeat(one, times.cast("int"))).otherwise(F.array(whole))
    # whole microseconds, so the frame is the same for either kind of timestamp; generic sleep has no windows, so its rows need no time
    counted = sample.select(*kind, "_times", F.when(F.col("staged"), micros(F.col("start_ts"))).alias("at"), F.explode(each).alias("_one")).select(*kind, "_times", "at", "_one.*")
    ahead = night.orderBy("at").rangeBetween(0, window * 60_000_000)
    mean = F.try_divide(F.sum("total").over(ahead), F.sum("values").over(ahead))
    windows = counted.select(*kind, mean.alias("mean"), F.sum("rows").over(ahead).alias("n"), "rows", "_times", F.when(~F.col("staged"), F.col("total")).alias("_generic"))
    full = F.col("staged") & (F.col("n") >= least_samples)
    told = windows.groupBy(*kind).agg(
        F.min(F.when(full, F.col("mean"))).alias("lowest"), F.coalesce(F.sum(F.when(full, F.col("rows"))), F.lit(0)).alias("windows"), F.percentile("_generic", F.lit(low), times).alias("low")
    ).drop("staged")
    out = slept.join(told, key, "left")
    long, enough = F.col("asleep_hours") >= least_hours, F.col("windows") >= least_windows
    value = F.when(F.col("staged"), F.when(long & enough, F.col("lowest"))).otherwise(F.when(long, F.col("low")))
    return out.select(
        *key, value.alias("value"), F.when(F.col("staged"), "stage_restricted").otherwise("p5_fallback").alias("source"), "asleep_hours",
        F.when(F.col("staged"), F.coalesce("windows", F.lit(0))).alias("valid_windows"),
    )


def sleep_inputs(sleep: DataFrame, by: list[str]) -> DataFrame:
    """(by, night, hours_asleep, deep_rem_h, awakenings, bed_start), segments summed as they are."""
    return sleep.groupBy(*by, wake_day(F.col("start_ts")).alias("night")).agg(*(c.alias(n) for n, c in _inputs().items()))


def _inputs() -> dict[str, Column]:
    length = seconds(F.col("end_ts")) - seconds(F.col("start_ts"))
    of = lambda *stages: F.sum(F.when(F.col("stage").isin(*stages), length)) / 3600
    return {"hours_asleep": of(*ASLEEP), "deep_rem_h": of("deep", "rem"), "awakenings": F.count(F.when(F.col("stage") == "awake", 1)), "bed_start": F.min("start_ts")}


def night_range(sleep: DataFrame, by: list[str]) -> DataFrame:
    """(by, first_night, last_night, nights)."""
    night = wake_day(F.col("start_ts"))
    return sleep.groupBy(*by).agg(F.min(night).alias("first_night"), F.max(night).alias("last_night"), F.countDistinct(night).alias("nights"))


def regularity(nights: DataFrame, by: list[str], days: int = 14) -> DataFrame:
    """``nights`` with the spread of bedtimes, in minutes, over the night and the ``days`` before."""
    w = rolling.day_window(by, "night", -days, 0)
    bed = minutes_past_18(F.col("bed_start")).cast("double")
    return nights.withColumn("_bed", bed).withColumn("regularity", F.when(F.count("_bed").over(w) >= 2, F.stddev_samp("_bed").over(w))).drop("_bed")


def night_inputs(sleep: DataFrame, records: DataFrame, by: list[str], hr_window: int = 5) -> DataFrame:
    """What a night itself gives: hours asleep and in deep or REM sleep, awakenings, bedtime, and a value of each metric."""
    table, key = night_table(sleep, by), [*by, "night"]
    means = {n: m for n, m in METRICS.items() if n != "sleeping_hr"}
    nights = table.select(*key, *_inputs()).join(night_values(table, records, by, means).select(*key, *means), key, "left")
    return nights.join(sleeping_rate(sleep, records, by, hr_window, nights=table).select(*key, F.col("value").alias("sleeping_hr")), key, "left")


def with_windows(nights: DataFrame, by: list[str], cfg: sc.Scoring = sc.DEFAULT) -> DataFrame:
    """``night_inputs`` with what the nights before give: baselines' values as short arrays, bedtimes' spread, days of history."""
    nights = regularity(nights, by)
    before = lambda c, first, last: bl.trailing(nights, by, "night", c, first, last)
    held = {f"{n}_base": before(n, -cfg.window_days, -1) for n in METRICS} | {"hours_base": before("hours_asleep", -cfg.window_days, -1)}
    held["hrv_recent"] = before("hrv", 1 - max(cfg.smoothing_days, 1), 0)
    held["history_days"] = F.datediff("night", F.min("night").over(Window.partitionBy(*by)))
    return nights.withColumns(held)


def recovery(sleep: DataFrame, records: DataFrame, by: list[str], cfg: sc.Scoring = sc.DEFAULT, hr_window: int = 5) -> DataFrame:
    """One row a night: state, score, band, confidence, ci, and z, sub-score and baseline size of each metric."""
    return scored_nights(with_windows(night_inputs(sleep, records, by, hr_window), by, cfg), by, cfg)


def scored_nights(nights: DataFrame, by: list[str], cfg: sc.Scoring = sc.DEFAULT) -> DataFrame:
    """``recovery`` of nights that have their windows: no night looks at another from here on."""
    key = [*by, "night"]
    nights = nights.withColumns({"hrv_logs": bl.logs(F.col("hrv_base")), "recent_logs": bl.logs(F.col("hrv_recent"))})
    nights = nights.withColumn("cv_base", bl.rolling_variations(F.col("hrv_logs"), cfg.smoothing_days))
    # one row for each night and metric: their baselines are one set of expressions
    sources = {"hrv": "hrv_logs", "sleeping_hr": "sleeping_hr_base", "resp": "resp_base", "temp": "temp_base", "hrv_cv": "cv_base"}
    whole = [c for c in nights.columns if c not in key]
    tall = nights.withColumn("m", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(c).alias("values")) for n, c in sources.items()))))
    tall = bl.with_baseline(tall.select(*key, F.struct(*whole).alias("night_row"), "m.metric", "m.values"), "values", "b", cfg)
    wide = {f"{n}_{c}": F.max(F.when(F.col("metric") == n, F.col(f"b_{c}"))) for n in sources for c in ("center", "scale")}
    nights = tall.groupBy(*key).agg(F.first("night_row").alias("night_row"), *(c.alias(n) for n, c in wide.items())).select(*key, "night_row.*", *wide)
    today = {"hrv": bl.average(F.col("recent_logs")), "sleeping_hr": F.col("sleeping_hr"), "resp": F.col("resp"), "temp": F.col("temp"), "hrv_cv": bl.variation(F.col("recent_logs"))}
    nights = nights.withColumns({f"{n}_z": sc.z_score(x, F.col(f"{n}_center"), F.col(f"{n}_scale")) for n, x in today.items()})
    share = F.try_divide(F.col("deep_rem_h"), F.nullif("hours_asleep", F.lit(0.0)))
    need = sc.sleep_need(bl.median(F.col("hours_base")), F.size("hours_base"), cfg)
    scored = {
        "hrv": sc.hrv_score(F.col("hrv_z"), cfg), "sleeping_hr": sc.higher_is_worse(F.col("sleeping_hr_z"), cfg), "resp": sc.higher_is_worse(F.col("resp_z"), cfg),
        "temp": sc.temperature_score(F.col("temp_z"), cfg=cfg), "hrv_cv": sc.higher_is_better(F.col("hrv_cv_z"), cfg),
        "sleep": sc.sleep_score(F.col("hours_asleep"), need, share, F.col("awakenings"), F.col("regularity"), cfg),
    }
    sizes = {n: F.size(f"{n}_base") for n in METRICS} | {"hrv_cv": F.size("cv_base"), "sleep": F.size("hours_base")}
    nights = nights.withColumns({f"{n}_score": s for n, s in scored.items()} | {f"{n}_samples": s for n, s in sizes.items()})
    parts = {n: F.col(f"{n}_score") for n in scored}
    trust = {n: sc.confidence(F.col(f"{n}_samples"), cfg) for n in scored}
    nights = nights.withColumns(sc.recovery(parts, trust, cfg))
    thin = (F.col("history_days") < cfg.min_history) | (F.col("confidence") < cfg.confident)
    state = F.when(F.col("score").isNull(), "insufficient_data").when(thin, "calibrating").otherwise("ok")
    few = F.filter(F.array(*(F.when(parts[n].isNotNull() & (F.col(f"{n}_samples") < cfg.min_samples), F.lit(n)) for n in METRICS)), lambda x: x.isNotNull())
    nights = nights.withColumns({"band": sc.band(F.col("score"), cfg), "state": state, "low_confidence": few})
    figures = [f"{n}_{c}" for n in scored for c in ("score", "samples")] + [f"{n}_{c}" for n in today for c in ("z", "center", "scale")]
    return nights.select(*key, "state", "history_days", "score", "band", "confidence", "ci", "low_confidence", "hours_asleep", "awakenings", "regularity", need.alias("need_h"), *METRICS, *figures)


def readiness(recovered: DataFrame, workouts: DataFrame, records: DataFrame, anchors: DataFrame, by: list[str], cfg: sc.Scoring = sc.DEFAULT, known_nights: DataFrame | None = None) -> DataFrame:
    """``recovered`` with workload, recovery still owed, illness signals and the readiness that follows.

    ``known_nights``: its (by, night), if they can be had without computing ``recovered`` again.
    """
    known_nights = recovered.select(*by, "night") if known_nights is None else known_nights
    days = load.daily_load(workouts, records, anchors, by).select(*by, "day", "load")
    # rest days up to the last night count as 0
    nights = known_nights.select(*by, F.col("night").alias("day"), F.lit(0.0).alias("load"))
    contiguous = rolling.all_days(days.unionByName(nights).groupBy(*by, "day").agg(F.sum("load").alias("load")), by, "day", ["load"])
    ratio = rolling.acwr(contiguous, by, since=load.data_start(workouts, records, by)).withColumnRenamed("day", "night")
    impulse = tr.trimp(F.coalesce("duration", F.lit(0.0)), F.col("avg_hr"), F.col("resting_hr"), F.col("hr_max"))
    done = workouts.join(anchors, by).filter("end_ts IS NOT NULL").select(
        *by, F.col("end_ts").cast("timestamp").alias("at"), F.struct(F.coalesce(impulse, F.coalesce("energy", F.lit(0.0)) * tr.ENERGY_LOAD).alias("load"), F.col("end_ts").cast("timestamp").alias("end")).alias("last")
    )
    probes = known_nights.select(*by, "night", (F.date_add("night", 1)).cast("timestamp").alias("at"))
    last = rolling.as_of(probes, done, by, "at", "last").drop("at")
    out = recovered.join(ratio, [*by, "night"], "left").join(last, [*by, "night"], "left")
    waited = (micros(F.col("night").cast("timestamp") + F.expr("INTERVAL 8 HOURS")) - micros(F.col("last.end"))) / 6e7
    out = out.withColumn("owed_h", F.when(F.col("last").isNull(), 0.0).otherwise(load.owed_hours(F.col("last.load"), waited)))
    ill = sc.illness({n: sc.settled(F.col(f"{n}_z"), 2) for n in METRICS}, cfg)
    out = out.withColumn("penalty", F.when(F.col("score").isNotNull(), sc.load_penalty(F.col("acwr"), F.col("owed_h"), cfg)))
    out = out.withColumn("readiness", sc.readiness(F.col("score"), F.col("penalty"), ill["triggered"], cfg)).withColumn("readiness_band", sc.band(F.col("readiness"), cfg))
    told = sc.recommendation(F.col("readiness_band"), F.col("acwr"), ill["triggered"] & F.col("score").isNotNull(), cfg)
    return out.withColumns({"recommendation": told, "illness": F.struct(*(c.alias(n) for n, c in ill.items())), "penalty": sc.settled(F.col("penalty"), 1), "owed_h": sc.settled(F.col("owed_h"), 1)}).drop("last")


def contributions(nights: DataFrame, by: list[str], cfg: sc.Scoring = sc.DEFAULT) -> DataFrame:
    """(by, place, metric, score, weight, contribution): what each sub-score of a night adds, heaviest first (by the weights as they are set).

    Weights shrink with the samples behind a score, unless all would be 0; they are shares of those present.
    """
    order = sorted(cfg.weights, key=lambda n: -cfg.weights[n])
    held = {n: F.col(f"{n}_score").isNotNull() for n in order}
    trusted = {n: F.when(held[n], cfg.weights[n] * sc.confidence(F.col(f"{n}_samples"), cfg)).otherwise(0.0) for n in order}
    plain = {n: F.when(held[n], cfg.weights[n]).otherwise(0.0) for n in order}
    sums = nights.withColumns({"_trusted": reduce(add, trusted.values()), "_plain": reduce(add, plain.values())})
    weight = {n: F.when(F.col("_trusted") > 0, trusted[n] / F.col("_trusted")).otherwise(F.try_divide(plain[n], F.col("_plain"))) for n in order}
    parts = [F.when(held[n], F.struct(F.lit(n).alias("metric"), F.col(f"{n}_score").alias("_score"), weight[n].alias("_weight"))) for n in order]
    told = sums.select(*by, F.posexplode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("place", "part"))
    score, share = F.col("part._score"), F.col("part._weight")
    return told.select(*by, "place", "part.metric", sc.settled(score, 1).alias("score"), sc.settled(share, 3).alias("weight"), sc.settled(score * share, 1).alias("contribution"))
