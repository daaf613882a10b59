"""Windows over days: rolling means, workload ratios, exponential averages, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.training import acwr_flag
from . import scans


def day_window(by: list[str], day: str, first: int, last: int) -> Window:
    """Rows whose day is ``first`` to ``last`` days after the row's own."""
    return Window.partitionBy(*by).orderBy(F.unix_date(F.col(day))).rangeBetween(first, last)


def rolling_mean(df: DataFrame, by: list[str], day: str, value: str, days: int, least: int | None = None) -> DataFrame:
    """Mean over the last ``days`` calendar days, where they hold ``least`` readings.

    Rounded twice, so that the order of a sum doesn't decide about a half.
    """
    least = least or max(2, days // 6)
    w = day_window(by, day, 1 - days, 0)
    known = df.filter(F.col(value).isNotNull())
    out = known.select(*by, day, F.round(F.round(F.avg(value).over(w), 9), 2).alias("mean"), F.count(value).over(w).alias("_n"))
    return out.filter(F.col("_n") >= least).drop("_n")


def all_days(df: DataFrame, by: list[str], day: str, values: list[str], last=None, step: int = 1) -> DataFrame:
    """Every ``step`` days from the first to the last (of each group, or the given one); missing values are 0.

    Each row fills the days up to the next one, so ``df`` is read once and joined with nothing.
    """
    following = F.lead(day).over(Window.partitionBy(*by).orderBy(day))
    end = F.col(day) if last is None else F.greatest(F.col(day), last)
    until = F.coalesce(F.date_sub(following, step), end)
    held = df.select(*by, F.col(day).alias("_own"), *values).withColumn(day, F.col("_own")).withColumn("_until", until)
    spread = held.withColumn(day, F.explode(F.sequence(F.col("_own"), F.col("_until"), F.expr(f"INTERVAL {step} DAYS"))))
    return spread.select(*by, day, *(F.when(F.col(day) == F.col("_own"), F.col(v)).alias(v) for v in values)).fillna(0, values)


def acwr(daily: DataFrame, by: list[str], day: str = "day", load: str = "load", since: DataFrame | None = None, acute: int = 7, chronic: int = 28, uncoupled: bool = True) -> DataFrame:
    """Acute and chronic load, their ratio and its flag, for each day of a day-contiguous series.

    ``since``: (by, start) the first day of all data; without it history begins with the series.
    """
    w = Window.partitionBy(*by).orderBy(day)
    scale = ((chronic - acute) if uncoupled else chronic) / acute
    short = F.sum(load).over(w.rowsBetween(1 - acute, 0))
    long = F.sum(load).over(w.rowsBetween(1 - chronic, -acute if uncoupled else 0))
    out = daily.withColumn("acute_7d", short).withColumn("_chronic", F.coalesce(long / scale, F.lit(0.0)))
    if since is None:
        enough = F.row_number().over(w) >= chronic
    else:
        out = out.join(since, by, "left")
        enough = F.coalesce(F.datediff(F.col(day), F.col("start")) >= chronic - 1, F.lit(True))
    ratio = F.when(F.col("_chronic") > 0, F.round(F.col("acute_7d") / F.col("_chronic"), 2))
    out = out.withColumn("acwr", ratio).withColumn("flag", acwr_flag(ratio, enough))
    return out.select(*by, day, F.round("acute_7d", 1).alias("acute_7d"), F.round("_chronic", 1).alias("chronic_28d_weekly"), "acwr", "flag")


def _power(r: float, n: Column) -> Column:
    return F.pow(F.lit(r), n.cast("double"))


def _shares(fatigue: int, fitness: int) -> dict[str, float]:
    """Of each average, what a day leaves of the one before."""
    return {"atl": 1 - 1 / fatigue, "ctl": 1 - 1 / fitness}


def load_in_blocks(daily: DataFrame, by: list[str], day: str = "day", load: str = "load", fatigue: int = 7, fitness: int = 42, block: int = 64) -> DataFrame:
    """(by, day, _block, _at, _atl, _ctl) of a day-contiguous series: what the days of each block since its beginning add.

    The recursion x += (load - x) / n keeps the share r = 1 - 1/n of what was there a day before. Inside a
    block of days its closed form is a running sum of loads over powers of r, which stay in range.
    """
    number = F.unix_date(F.col(day))
    days = daily.select(*by, day, F.col(load).cast("double").alias("_load"), F.floor(number / block).alias("_block"), F.pmod(number, F.lit(block)).alias("_at"))
    w = Window.partitionBy(*by, "_block").orderBy("_at")
    own = {f"_{x}": F.sum(F.col("_load") * _power(r, -F.col("_at"))).over(w) * _power(r, F.col("_at")) * (1 - r) for x, r in _shares(fatigue, fitness).items()}
    return days.withColumns(own).drop("_load")


def carried_load(own: DataFrame, by: list[str], day: str = "day", fatigue: int = 7, fitness: int = 42, block: int = 64) -> DataFrame:
    """Fatigue, fitness and form of each day from ``load_in_blocks``: what blocks hand on is folded over each athlete's blocks."""
    keep = _shares(fatigue, fitness)
    ends = own.groupBy(*by, "_block").agg(*(F.max_by(f"_{x}", "_at").alias(x) for x in keep))
    blocks = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", *keep))).alias("_blocks"))
    start = F.expr("named_struct('atl', 0D, 'ctl', 0D, 'out', CAST(array() AS array<struct<_block:bigint,atl:double,ctl:double>>))")

    def step(held, x):
        handed = F.struct(x["_block"].alias("_block"), held.atl.alias("atl"), held.ctl.alias("ctl"))
        return F.struct(*((held[k] * r**block + x[k]).alias(k) for k, r in keep.items()), F.array_append(held.out, handed).alias("out"))

    before = blocks.select(*by, F.explode(F.aggregate("_blocks", start, step, lambda held: held.out)).alias("_r")).select(*by, "_r.*")
    both = own.join(before, [*by, "_block"])
    found = both.withColumns({x: F.col(x) * _power(r, F.col("_at") + 1) + F.col(f"_{x}") for x, r in keep.items()})
    return found.select(*by, day, F.round("atl", 1).alias("atl"), F.round("ctl", 1).alias("ctl"), F.round(F.col("ctl") - F.col("atl"), 1).alias("tsb"))


def exponential_load(daily: DataFrame, by: list[str], day: str = "day", load: str = "load", fatigue: int = 7, fitness: int = 42, block: int = 64) -> DataFrame:
    """Fatigue, fitness and form of each day of a day-contiguous series, in blocks of days."""
    return carried_load(load_in_blocks(daily, by, day, load, fatigue, fitness, block), by, day, fatigue, fitness, block)


def streaks(df: DataFrame, by: list[str], day: str, days_apart: int = 7) -> DataFrame:
    """(by, first, last, n) of runs of days (weeks) that follow one another."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(day))
    anchor = F.date_sub(F.col(day), (number * days_apart).cast("int"))
    return df.withColumn("_anchor", anchor).groupBy(*by, "_anchor").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n")).drop("_anchor")


def block_variation(df: DataFrame, by: list[str], day: str, value: str, width: int) -> DataFrame:
    """(by, day, cv): coefficient of variation of each ``width`` consecutive values."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(1 - width, 0)
    share = F.try_divide(F.stddev_samp(value).over(w), F.abs(F.avg(value).over(w)))
    return df.select(*by, day, F.count(value).over(w).alias("_n"), share.alias("cv")).filter(F.col("_n") == width).drop("_n")


def newest(df: DataFrame, by: list[str], day: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(day)))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def as_of(probes: DataFrame, facts: DataFrame, by: list[str], day: str, value: str, default=None, block: Column | None = None) -> DataFrame:
    """``probes`` with the latest ``value`` on or before their day (of several at once the greatest): one sort by key and day, no range join.

    Give a ``block`` of the day (a month of it) where a key's history is long; blocks then are worked on side by side.
    """
    columns = probes.columns
    marked = probes.withColumn("_fact", F.lit(None).cast(facts.schema[value].dataType)).withColumn("_probe", F.lit(1))
    known = facts.filter(F.col(value).isNotNull()).select(*by, day, F.col(value).alias("_fact")).withColumn("_probe", F.lit(0))
    both = marked.unionByName(known, allowMissingColumns=True)
    if block is None:
        w = Window.partitionBy(*by).orderBy(day, "_probe", "_fact").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn(value, F.last("_fact", ignorenulls=True).over(w))
    else:
        both = scans.running(both, by, [day, "_probe", "_fact"], block, {value: scans.Scan("last", F.col("_fact"))})
    out = both.filter("_probe = 1").select(*columns, value)
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))
