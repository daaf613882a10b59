"""Personal baselines: trailing values, weighted quantiles, robust centre and scale.

A baseline looks at 28 days at most, so its values travel as one short array for each
night, and all arithmetic is array expressions: every night of every athlete at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import DEFAULT, Scoring
from .rolling import day_window


def trailing(df: DataFrame, by: list[str], day: str, value: str, first: int, last: int) -> Column:
    """The values of the days ``first`` to ``last`` from the row's own, in order of days, without nulls."""
    pair = F.when(F.col(value).isNotNull(), F.struct(F.col(day).alias("d"), F.col(value).cast("double").alias("v")))
    held = F.array_sort(F.collect_list(pair).over(day_window(by, day, first, last)))
    return F.transform(held, lambda x: x.v)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def average(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.nullif(F.size(values), F.lit(0)))


def spread(values: Column, mean: Column) -> Column:
    """Sample standard deviation about a known mean; 0 below two values."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(values) < 2, 0.0).otherwise(F.sqrt(squares / F.greatest(F.size(values) - 1, F.lit(1))))


def sample_sd(values: Column) -> Column:
    return let(average(values), lambda mean: spread(values, mean))


def middle(ordered: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(ordered)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def median(values: Column) -> Column:
    return let(F.array_sort(values), middle)


def variation(values: Column) -> Column:
    """Coefficient of variation; null below two values or at mean 0."""
    share = let(average(values), lambda mean: F.try_divide(spread(values, mean), F.nullif(F.abs(mean), F.lit(0.0))))
    return F.when(F.size(values) >= 2, share)


def rolling_variations(values: Column, width: int) -> Column:
    """Variation of each ``width`` consecutive values, where defined."""
    n = F.size(values)
    starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    blocks = F.transform(starts, lambda i: F.slice(values, i, width))
    return F.filter(F.transform(blocks, variation), lambda x: x.isNotNull())


def weighted_quantile(ordered: Column, total: Column, q: float) -> Column:
    """Quantile of a sorted array of struct<v, w> of that total weight.

    Plotting positions are (sum so far - w / 2) / total, linear between, ends clamped.
    """
    start = F.expr("named_struct('sum', 0D, 'at', CAST(NULL AS DOUBLE), 'v', CAST(NULL AS DOUBLE), 'out', CAST(NULL AS DOUBLE))")

    def step(acc, x):
        at = (acc["sum"] + x.w / 2) / total
        between = acc.v + F.coalesce(F.try_divide(q - acc["at"], F.nullif(at - acc["at"], F.lit(0.0))), F.lit(0.0)) * (x.v - acc.v)
        here = F.when(acc["out"].isNotNull(), acc["out"]).when(F.lit(q) <= at, F.coalesce(between, x.v))
        return F.struct((acc["sum"] + x.w).alias("sum"), at.alias("at"), x.v.alias("v"), here.alias("out"))

    return F.when(total > 0, F.aggregate(ordered, start, step, lambda acc: F.coalesce(acc["out"], acc.v)))


def with_baseline(df: DataFrame, values: str, prefix: str, cfg: Scoring = DEFAULT) -> DataFrame:
    """``df`` with <prefix>_center, <prefix>_scale and <prefix>_n of an array of values in order of time.

    Values are cut to the median and some robust deviations around it; a weight halves
    every half-life of places. Each step is a column of its own, so the next ones refer
    to it instead of repeating its expression.
    """
    center, scale = f"{prefix}_center", f"{prefix}_scale"
    out = df.withColumn(f"{prefix}_n", F.size(values)).withColumn("_work", F.col(values))
    if cfg.winsorize:
        out = out.withColumn("_mid", median(F.col(values)))
        out = out.withColumn("_cut", cfg.winsor_k * 1.4826 * median(F.transform(values, lambda v: F.abs(v - F.col("_mid")))))
        held = F.transform(values, lambda v: F.least(F.col("_mid") + F.col("_cut"), F.greatest(F.col("_mid") - F.col("_cut"), v)))
        out = out.withColumn("_work", F.when((F.size(values) >= 2) & (F.col("_cut") > 0), held).otherwise(F.col(values)))
    n, decay = F.size("_work"), 0.5 ** (1 / cfg.half_life)
    weigh = lambda v, i: F.struct(v.alias("v"), (F.pow(F.lit(decay), n - 1 - i) if cfg.ewma else F.lit(1.0)).alias("w"))
    out = out.withColumn("_pairs", F.array_sort(F.transform("_work", weigh)))
    out = out.withColumn("_total", F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p.w))
    if cfg.robust:
        out = out.withColumn(center, weighted_quantile(F.col("_pairs"), F.col("_total"), 0.5))
        out = out.withColumn("_away", F.array_sort(F.transform("_pairs", lambda p: F.struct(F.abs(p.v - F.col(center)).alias("v"), p.w.alias("w")))))
        out = out.withColumn(scale, F.coalesce(1.4826 * weighted_quantile(F.col("_away"), F.col("_total"), 0.5), F.lit(0.0)))
    else:
        whole = F.nullif("_total", F.lit(0.0))
        out = out.withColumn(center, F.try_divide(F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p.w * p.v), whole))
        out = out.withColumn("_away", F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p.w * (p.v - F.col(center)) * (p.v - F.col(center))))
        free = F.col("_total") - F.try_divide(F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + p.w * p.w), whole)
        out = out.withColumn(scale, F.when((F.size("_work") >= 2) & (free > 0), F.sqrt(F.col("_away") / free)).otherwise(0.0))
    return out.drop("_work", "_mid", "_cut", "_pairs", "_total", "_away")


def logs(values: Column) -> Column:
    """Natural logarithms of the positive values."""
    return F.transform(F.filter(values, lambda v: v > 0), lambda v: F.log(v))
