"""Intervals: union of overlapping ones, and joins of points with the intervals that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros, seconds
from . import scans


#: Blocks that an interval is laid out in at most; the sizes of blocks grow fourfold.
MOST_BLOCKS, GROWTH, SIZES = 16, 4, 14


def islands(df: DataFrame, by: list[str], start: str = "start_ts", end: str = "end_ts", block: Column | None = None) -> DataFrame:
    """(by, island_start, island_end): maximal unions of overlapping or touching intervals.

    Without ``block`` a group is one sort. Give a ``block`` that doesn't fall as ``start`` rises (a day or month
    of it) where a group's history is long: blocks then are worked on side by side (see ``scans.running``).
    """
    if block is None:
        earlier = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
        reach = df.select(*by, start, end).withColumn("_reach", F.max(end).over(earlier))
        opens = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
        numbered = reach.withColumn("_island", F.sum(opens).over(upto))
        return numbered.groupBy(*by, "_island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end")).drop("_island")
    own = df.select(*by, F.col(start).alias("island_start"), F.col(end).alias("island_end"), block.alias("_in"))
    parts = islands(own, [*by, "_in"], "island_start", "island_end")  # what a block can settle by itself
    reach = scans.running(parts, by, ["island_start", "island_end"], F.col("_in"), {"_reach": scans.Scan("max", F.col("island_end"), before=True)})
    opening = F.when(F.col("_reach").isNull() | (F.col("island_start") > F.col("_reach")), F.col("island_start"))
    named = scans.running(reach.withColumn("_opens", opening), by, ["island_start", "island_end"], F.col("_in"), {"_island": scans.Scan("last", F.col("_opens"))})
    return named.groupBy(*by, F.col("_island")).agg(F.min("island_start").alias("island_start"), F.max("island_end").alias("island_end")).drop("_island")


def union_hours(df: DataFrame, by: list[str], start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """(by, hours, first_start): time covered, each minute once."""
    spans = islands(df, by, start, end)
    hours = F.sum(micros(F.col("island_end")) - micros(F.col("island_start"))) / 3.6e9
    return spans.groupBy(*by).agg(hours.alias("hours"), F.min("island_start").alias("first_start"))


def laid_out(spans: DataFrame, start: str, end: str, bucket: int = 3600) -> DataFrame:
    """``spans`` once for each aligned block that they touch, with _size and _block.

    Of the block sizes, ``bucket`` seconds and GROWTH times as long each, an interval takes the smallest of
    which it touches MOST_BLOCKS at most: a second or a century, it is that many rows.
    """
    held = spans.filter(F.col(end) >= F.col(start))
    first, last = seconds(F.col(start)), seconds(F.col(end))
    sizes = [bucket * GROWTH**k for k in range(SIZES)]
    fits = [F.when(F.floor(last / size) - F.floor(first / size) < MOST_BLOCKS, F.lit(size).cast("long")) for size in sizes]
    sized = held.withColumn("_size", F.coalesce(*fits))
    return sized.withColumn("_block", F.explode(F.sequence(F.floor(first / F.col("_size")), F.floor(last / F.col("_size")))))


def points_in(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, closed: bool, bucket: int = 3600) -> DataFrame:
    """Inner join of points with the intervals that hold them: start <= at < end, or <= end if ``closed``.

    An equi-join on (``on``, block of time) that keeps the range as a residual, so it is
    hashed and shuffled by key and time instead of comparing all pairs. A point carries its
    block of each size that some interval has: one, where all have a usual length near
    ``bucket``, and one more for each fourfold length beyond MOST_BLOCKS of these.
    """
    laid = laid_out(spans, start, end, bucket)
    used = laid.agg(F.collect_set("_size").alias("_sizes")).scalar()  # a scalar subquery: SIZES numbers at most
    placed = points.withColumn("_sizes", used).withColumn("_size", F.explode("_sizes")).drop("_sizes").withColumn("_block", F.floor(seconds(F.col(at)) / F.col("_size")))
    joined = placed.join(laid, [*on, "_size", "_block"]).drop("_size", "_block")
    inside = F.col(at) >= F.col(start)
    return joined.filter(inside & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end))))


def cells(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, bucket: int = 3600) -> tuple[DataFrame, DataFrame]:
    """``points`` and ``spans`` with _size and _block, so that a span's points all have its own.

    A span is one row, in the block of its start, of the smallest of SIZES sizes (GROWTH times as long each) that is
    as long as the span. So it ends in the next block at the latest: a point is in its own block and the one before.
    """
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    first, last = seconds(F.col(start)), seconds(F.col(end))
    fits = [F.when(last - first <= bucket * GROWTH**k, F.lit(bucket * GROWTH**k).cast("long")) for k in range(SIZES)]
    sized = spans.filter(known & (F.col(end) >= F.col(start))).withColumn("_size", F.coalesce(*fits))
    used = sized.agg(F.collect_set("_size").alias("_sizes")).scalar()  # a scalar subquery: SIZES numbers at most
    own = F.floor(seconds(F.col(at)) / F.col("_size"))
    placed = points.filter(known & F.col(at).isNotNull()).withColumn("_sizes", used).withColumn("_size", F.explode("_sizes")).drop("_sizes")
    return placed.withColumn("_block", F.explode(F.array(own, own - 1))), sized.withColumn("_block", F.floor(first / F.col("_size")))


def covering(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, block: Column | None = None) -> DataFrame:
    """``points`` that some interval holds (start <= at < end), with ``_times``: how many do.

    A running count of starts and ends in order of time, not a row for each pair, so intervals that lie over one
    another cost nothing. Without ``block`` a group (a night, say) is one sort and all is shuffled once, by ``on``;
    where a group's history is long, give a ``block`` of ``at`` (see ``scans.running``).
    """
    held = spans.filter(F.col(end) > F.col(start))
    turns = held.select(*on, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("n")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("n")))).alias("_turn"))
    if block is None:
        turns = turns.select(*on, F.col("_turn.t").alias(at), F.col("_turn.n").cast("long").alias("_turns"))
    else:
        turns = turns.groupBy(*on, F.col("_turn.t").alias(at)).agg(F.sum("_turn.n").alias("_turns"))
    both = points.withColumn("_point", F.lit(1)).unionByName(turns.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    if block is None:
        run = both.withColumn("_times", F.sum("_turns").over(Window.partitionBy(*on).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        run = scans.running(both, on, [at, "_point"], block, {"_times": scans.Scan("sum", F.col("_turns"))})
    return run.filter("_point = 1 AND _times > 0").drop("_point", "_turns")


def points_covered(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, bucket: int = 3600, block: Column | None = None) -> DataFrame:
    """Points that some interval holds, ends included, each once.

    The intervals are made disjoint first (by ``block``, see ``islands``), so a point meets one of them at most.
    """
    disjoint = islands(spans.filter(F.col(end) >= F.col(start)), on, start, end, block)
    return points_in(points, disjoint, on, at, "island_start", "island_end", True, bucket).drop("island_start", "island_end")


def averages_within(spans: DataFrame, points: DataFrame, on: list[str], key: list[str], at: str, value: str, start: str, end: str, bucket: int = 3600) -> DataFrame:
    """(on, key, value, samples) of every interval; without points value is null and samples 0."""
    found = points_in(points.select(*on, at, value), spans.select(*on, *key, start, end), on, at, start, end, True, bucket)
    means = found.groupBy(*on, *key).agg(F.avg(value).alias("value"), F.count(value).alias("samples"))
    return spans.select(*on, *key).join(means, [*on, *key], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
