"""Exact interpolated quantiles of groups of any size, by distributed selection.

``percentile`` holds a group's distinct values in one task. Here every value is counted
instead: a histogram between a group's least and greatest value tells which bin holds the
wanted rank, the next one divides that bin, and so on until a bin holds few rows or one
value. Only rows of bins in question are counted again; what meets in a task is a
group's bins, or the rows of a small bin.

A bin's edges are its own least and greatest value, so each round splits every bin that has
two values, and bins follow the order of values whatever the floating point does: results
are those of sorting. Very uneven values take more rounds, not larger tasks: rounds take turns
between equal widths and equal widths of logarithms.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import workspace

BINS = 1024
#: Rows of a bin that are sorted out at once.
SMALL = 20_000
#: Groups whose bins in question are sent to all tasks; with more of them both sides are shuffled.
BROADCAST_ROWS = 100_000


def _within(rows: DataFrame, ranges: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows of the groups' ranges (``by``, lo, hi)."""
    named = ranges.select(*(F.col(c).alias(f"_k_{c}") for c in by), "lo", "hi")
    same = reduce(and_, [F.col(f"_k_{c}").eqNullSafe(F.col(c)) for c in by], F.col("_value").between(F.col("lo"), F.col("hi")))
    return rows.join(F.broadcast(named) if n <= BROADCAST_ROWS else named, same).drop(*(f"_k_{c}" for c in by))


def _bin(even: bool):
    """The bin of a value between lo and hi, 0 to BINS - 1; never falls as the value rises."""
    shape = (lambda c: c) if even else (lambda c: F.signum(c) * F.log1p(F.abs(c)))
    at, lo, hi = (shape(F.col(c).cast("double")) for c in ("_value", "lo", "hi"))
    share = F.when(hi > lo, (at - lo) / (hi - lo)).otherwise(0.0)
    # the ends have bins of their own whatever rounding does, so that each round splits
    inner = F.least(F.lit(BINS - 2), F.greatest(F.lit(1), F.floor(share * (BINS - 2)) + 1))
    return F.when(F.col("_value") == F.col("lo"), 0).when(F.col("_value") == F.col("hi"), BINS - 1).otherwise(inner).cast("int")


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], small: int = SMALL) -> DataFrame:
    """(by, n, a column for each named share): quantiles between 0 and 1, interpolated between neighbours.

    Null and NaN values don't count; a group without values is left out. Null keys are a group.
    """
    spark = df.sparkSession
    folder = workspace(spark, "quantiles")
    rows = df.select(*by, F.col(value).alias("_value")).filter(F.col("_value").isNotNull() & ~F.isnan(F.col("_value").cast("double")))
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_value").alias("lo"), F.max("_value").alias("hi"))
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share"), F.lit(side).alias("side")) for name, share in shares.items() for side in (0, 1)]
    place = (F.col("n") - 1) * F.col("want.share")
    rank = F.when(F.col("want.side") == 0, F.floor(place)).otherwise(F.ceil(place))
    open_ = ends.withColumn("want", F.explode(F.array(*wanted))).select(*by, "n", "want.*", rank.alias("rank"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), "lo", "hi")
    turn = 0
    while True:
        path = f"{folder}/{turn}"
        open_.write.parquet(path)
        open_ = spark.read.schema(open_.schema).parquet(path)
        big = (F.col("inside") > small) & (F.col("lo") < F.col("hi"))
        todo = open_.filter(big).select(*by, "lo", "hi").distinct()
        if not (n := todo.count()):
            break
        counted = _within(rows, todo, by, n).groupBy(*by, "lo", "hi", _bin(turn % 2 == 0).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
        below = F.sum("_n").over(Window.partitionBy(*by, "lo", "hi").orderBy("_bin")) - F.col("_n")
        bins = counted.withColumn("_below", below).select(*(F.col(c).alias(f"_k_{c}") for c in (*by, "lo", "hi")), "_n", "_lo", "_hi", "_below")
        same = reduce(and_, [F.col(f"_k_{c}").eqNullSafe(F.col(c)) for c in (*by, "lo", "hi")])
        holds = (F.col("rank") >= F.col("before") + F.col("_below")) & (F.col("rank") < F.col("before") + F.col("_below") + F.col("_n"))
        found = open_.filter(big).join(bins, same & holds)
        columns = [*by, "n", "name", "share", "side", "rank"]
        narrowed = found.select(*columns, (F.col("before") + F.col("_below")).alias("before"), F.col("_n").alias("inside"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
        open_ = narrowed.unionByName(open_.filter(~big))
        turn += 1
    # what is left: single values, and bins small enough to be sorted
    few = open_.filter("lo < hi")
    ranges = few.select(*by, "lo", "hi").distinct()
    held = _within(rows, ranges, by, ranges.count()).groupBy(*by, "lo", "hi", "_value").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "lo", "hi").orderBy("_value"))
    held = held.withColumn("_upto", upto).select(*(F.col(c).alias(f"_k_{c}") for c in (*by, "lo", "hi")), "_value", "_n", "_upto")
    same = reduce(and_, [F.col(f"_k_{c}").eqNullSafe(F.col(c)) for c in (*by, "lo", "hi")])
    at = F.col("rank") - F.col("before")
    told = few.join(held, same & (at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_n"))).select(*by, "n", "name", "share", "side", "_value")
    told = told.unionByName(open_.filter("lo = hi").select(*by, "n", "name", "share", "side", F.col("lo").alias("_value")))
    of = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_value").cast("double")))
    out = told.groupBy(*by, "n").agg(*(of(name, side).alias(f"_{side}_{name}") for name in shares for side in (0, 1)))
    rest = lambda share: (F.col("n") - 1) * share - F.floor((F.col("n") - 1) * F.lit(float(share)))
    return out.select(*by, "n", *((F.col(f"_0_{name}") + (F.col(f"_1_{name}") - F.col(f"_0_{name}")) * rest(share)).alias(name) for name, share in shares.items()))
