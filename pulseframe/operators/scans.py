"""Running sums, maxima and last values over one group's long history, block by block.

Two passes: each block of a group runs by itself and gives one summary row; what a block
takes over from those before it is folded over the group's summaries and added on. A
group's rows are thus as many tasks as it has blocks; only its summaries meet, one row
for each block. Choose blocks (a day, a month, a range of keys) of some thousand rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scan:
    """What runs: ``kind`` is sum, max or last (the last value that isn't null); ``before`` leaves out the row itself."""

    kind: str
    value: Column
    before: bool = False


def _joined(kind: str, held: Column, own: Column) -> Column:
    """What two stretches that follow one another give; null stands for nothing."""
    if kind == "sum":
        return F.when(held.isNull(), own).when(own.isNull(), held).otherwise(held + own)
    if kind == "max":
        return F.greatest(held, own)
    return F.coalesce(own, held)


def running(df: DataFrame, by: list[str], order: list[str], block: Column, scans: dict[str, Scan]) -> DataFrame:
    """``df`` with the named running values of each ``by`` group in the order given.

    ``block`` must not fall as rows go up in ``order``, and rows of one block that tie in all of
    ``order`` run in any order. Null keys are a group like any other.
    """
    first = df.withColumn("_blk", block).withColumns({f"_v_{n}": s.value for n, s in scans.items()})
    w = Window.partitionBy(*by, "_blk").orderBy(*order)
    whole, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    of = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    local = first.withColumns({f"_r_{n}": of[s.kind](f"_v_{n}").over(earlier if s.before else whole) for n, s in scans.items()})
    end = F.struct(*order)
    last = lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), end))
    told = first.groupBy(*by, "_blk").agg(*((last(n) if s.kind == "last" else of[s.kind](f"_v_{n}")).alias(n) for n, s in scans.items()))
    before = carried(told, by, scans)
    same = reduce(and_, [F.col(f"_k_{c}").eqNullSafe(F.col(c)) for c in (*by, "_blk")])
    both = local.join(before.select(*(F.col(c).alias(f"_k_{c}") for c in (*by, "_blk")), *(F.col(n).alias(f"_b_{n}") for n in scans)), same)
    return both.select(*df.columns, *(_joined(s.kind, F.col(f"_b_{n}"), F.col(f"_r_{n}")).alias(n) for n, s in scans.items()))


def carried(told: DataFrame, by: list[str], scans: dict[str, Scan]) -> DataFrame:
    """For each block (``by``, _blk) what all blocks before it give; ``told`` has a row for each block."""
    fields = {f.name: f.dataType.simpleString() for f in told.schema.fields}
    parts = F.array_sort(F.collect_list(F.struct("_blk", *scans))).alias("_parts")
    start = F.struct(*(F.lit(None).cast(fields[n]).alias(n) for n in scans), F.array().cast(f"array<struct<_blk:{fields['_blk']},{','.join(f'{n}:{fields[n]}' for n in scans)}>>").alias("out"))

    def step(held, x):
        handed = F.struct(x["_blk"].alias("_blk"), *(held[n].alias(n) for n in scans))
        return F.struct(*(_joined(s.kind, held[n], x[n]).alias(n) for n, s in scans.items()), F.array_append(held["out"], handed).alias("out"))

    folded = told.groupBy(*by).agg(parts).select(*by, F.explode(F.aggregate("_parts", start, step, lambda held: held["out"])).alias("_one"))
    return folded.select(*by, "_one.*")
