"""Daily load, workload ratio and fitness kept up to date: a late delta computes again only what it touches.

A day's load depends on that day's rows alone, its ratio on the 28 days up to it, and fatigue and
fitness on all days before, but only through what blocks of days hand on. So tables lie in
parts, an athlete's shard by a block of days. A delta names (athlete, day) pairs; their loads are
computed again, then the series of the blocks that 28 days from them reach, and those parts
alone are written. What blocks hand on to later ones is folded when fitness is read: a row for each
block. Parts of one update become visible together (``sources.commits``).

Anchors (maximum and resting heart rate) are given; where they change, build anew. Rows are only ever
added, as in the store, so a day that has a load keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import load, rolling
from ..sources.commits import Commits
from ..sources.workspace import workspace

SERIES = ("acute_7d", "chronic_28d_weekly", "acwr", "flag", "_at", "_atl", "_ctl")
REACH = 27  #: days after a day whose ratio it is part of


def changed_days(workouts: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """(by, day) of the rows of a delta that load depends on."""
    energy = records.filter("type = 'active_energy'")
    return workouts.select(*by, F.to_date("start_ts").alias("day")).unionByName(energy.select(*by, F.to_date("start_ts").alias("day"))).distinct()


class Maintained:
    def __init__(self, spark: SparkSession, root: str, by: list[str], block: int = 64, shards: int = 16):
        self.spark, self.root, self.by, self.block, self.shards = spark, root.rstrip("/"), by, block, shards
        self.commits = Commits(spark, self.root)

    def _shard(self):
        return F.pmod(F.xxhash64(*self.by), F.lit(self.shards)).cast("int")

    def _block(self, day):
        return F.floor(F.unix_date(day) / self.block).cast("int")

    def _held(self, name: str, state: dict, parts: set[tuple[int, int]] | None = None) -> DataFrame | None:
        """A table, or some of its parts."""
        entries = state["tables"].get(name, {})
        chosen = [f"{self.root}/{name}/update={own}/shard={key.split('/')[0]}/block={key.split('/')[1]}" for key, own in entries.items() if parts is None or tuple(map(int, key.split("/"))) in parts]
        if not chosen:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*chosen).drop("update")

    def _write(self, name: str, rows: DataFrame, own: str, state: dict) -> set[tuple[int, int]]:
        """Writes parts (shard, block of ``rows``) of a table and notes them; which they are."""
        rows.repartition("shard", "block").write.partitionBy("shard", "block").parquet(f"{self.root}/{name}/update={own}")
        files, parts = self.commits.files, set()
        top = f"{self.root}/{name}/update={own}"
        for shard in files.names(top):
            for block in files.names(f"{top}/{shard}") if shard.startswith("shard=") else ():
                parts.add((int(shard[6:]), int(block[6:])))
        for shard, block in parts:
            state["tables"].setdefault(name, {})[f"{shard}/{block}"] = own
        return parts

    def _kept(self, name: str, state: dict, parts: set[tuple[int, int]], again: DataFrame, on: list[str]) -> DataFrame | None:
        """Rows of parts that are written anew which themselves stay."""
        old = self._held(name, state, parts)
        return None if old is None else old.join(again.select(*on).distinct(), on, "left_anti")

    def update(self, workouts: DataFrame, records: DataFrame, anchors: DataFrame, changed: DataFrame | None = None) -> dict[str, set[tuple[int, int]]]:
        """Brings the tables up to date with ``workouts`` and ``records`` (all rows, the delta's among them).

        ``changed`` are the delta's (by, day); without it everything is built anew. Returns the parts written, by table.
        """
        by, own, state = self.by, uuid.uuid4().hex, self.commits.latest()
        work, done = workspace(self.spark, "maintained"), {}
        state["version"] += 1
        if changed is None:
            state["tables"], changed = {}, changed_days(workouts, records, by)
        changed.write.parquet(f"{work}/changed")
        changed = self.spark.read.schema(changed.schema).parquet(f"{work}/changed")
        first, last = changed.agg(F.min("day"), F.max("day")).first()
        if first is None:
            return {}
        near = F.to_date("start_ts").between(F.lit(first), F.lit(last))  # lets scans skip what is out of reach
        those = lambda rows: rows.filter(near).withColumn("day", F.to_date("start_ts")).join(changed, [*by, "day"], "left_semi").drop("day")
        recent, energy = those(workouts), those(records.filter("type = 'active_energy'"))
        loads = load.daily_load(recent, energy, anchors, by).withColumns({"shard": self._shard(), "block": self._block(F.col("day"))})
        loads.write.parquet(f"{work}/loads")
        loads = self.spark.read.schema(loads.schema).parquet(f"{work}/loads")
        parts = {(r[0], r[1]) for r in loads.select("shard", "block").distinct().collect()}
        kept = self._kept("loads", state, parts, changed, [*by, "day"])
        done["loads"] = self._write("loads", loads if kept is None else loads.unionByName(kept), own, state)

        # where each athlete's days begin and end, before and now
        before = self._held("ranges", state)
        now = loads.groupBy(*by).agg(F.min("day").alias("first"), F.max("day").alias("last")).join(load.data_start(recent, energy, by), by, "full_outer")
        both = now.select(*by, "first", "last", "start") if before is None else now.select(*by, "first", "last", "start").unionByName(before.select(*by, "first", "last", "start"))
        ranges = both.groupBy(*by).agg(*(f(c).alias(c) for c, f in (("first", F.min), ("last", F.max), ("start", F.min))))
        ranges.write.parquet(f"{work}/ranges")
        ranges = self.spark.read.schema(ranges.schema).parquet(f"{work}/ranges")
        done["ranges"] = self._write("ranges", ranges.withColumns({"shard": self._shard(), "block": F.lit(0)}), own, state)

        # stretches whose series may differ, and the blocks that they reach
        if before is None:
            spans = ranges.select(*by, F.col("first").alias("a"), F.col("last").alias("b"))
        else:
            old = before.select(*by, *(F.col(c).alias(f"old_{c}") for c in ("first", "last", "start")))
            known = ranges.join(old, by, "left")
            late = loads.select(*by, F.col("day").alias("a"), F.date_add("day", REACH).alias("b"))
            grown = known.filter(F.col("old_last").isNull() | (F.col("last") > F.col("old_last"))).select(*by, F.coalesce(F.date_add("old_last", 1), "first").alias("a"), F.col("last").alias("b"))
            begun = known.filter((F.col("first") < F.col("old_first")) | (F.col("start") < F.col("old_start"))).select(*by, F.col("first").alias("a"), F.date_add(F.greatest("old_first", "old_start"), REACH).alias("b"))
            spans = late.unionByName(grown).unionByName(begun)
        blocks = F.sequence(self._block(F.greatest("a", "first")), self._block(F.least("b", "last")))
        reached = spans.join(ranges, by).filter(F.greatest("a", "first") <= F.least("b", "last")).select(*by, "first", "last", "start", F.explode(blocks).alias("block")).distinct()
        reached.withColumn("shard", self._shard()).write.parquet(f"{work}/reached")
        reached = self.spark.read.parquet(f"{work}/reached")
        parts = {(r[0], r[1]) for r in reached.select("shard", "block").distinct().collect()}
        wide = {(s, b - k) for s, b in parts for k in range(-(-REACH // self.block) + 1)}
        opens = F.date_from_unix_date(F.col("block") * self.block)
        begin, end = F.greatest("first", F.date_sub(opens, REACH)), F.least("last", F.date_add(opens, self.block - 1))
        dense = reached.withColumn("opens", opens).select(*by, "shard", "block", "opens", F.explode(F.sequence(begin, end)).alias("day"))
        known = self._held("loads", state, wide).select(*by, "day", "load")
        dense = dense.join(known, [*by, "day"], "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
        group = [*by, "shard", "block"]
        ratio = rolling.acwr(dense, group, since=reached.select(*group, "start"))
        inner = dense.filter(F.col("day") >= F.col("opens"))
        fitness = rolling.load_in_blocks(inner, group, block=self.block)
        series = fitness.join(ratio, [*group, "day"]).select(*by, "day", *SERIES, "shard", "block")
        kept = self._kept("series", state, parts, reached, [*by, "block"])
        done["series"] = self._write("series", series if kept is None else series.unionByName(kept), own, state)
        self.commits.commit(state)
        return done

    def loads(self) -> DataFrame:
        """(by, day, load, workouts, method)."""
        return self._held("loads", self.commits.latest()).drop("shard", "block")

    def series(self) -> DataFrame:
        """(by, day) with workload ratio, fatigue, fitness and form of every day."""
        held = self._held("series", self.commits.latest())
        own = held.select(*self.by, "day", F.col("block").cast("long").alias("_block"), "_at", "_atl", "_ctl")
        form = rolling.carried_load(own, self.by, block=self.block)
        return held.select(*self.by, "day", *SERIES[:4]).join(form, [*self.by, "day"])

    def vacuum(self) -> int:
        """Deletes updates of which no part is in use; how many."""
        state, gone = self.commits.latest(), 0
        for name, parts in state["tables"].items():
            for own in self.commits.files.names(f"{self.root}/{name}"):
                if own.removeprefix("update=") not in set(parts.values()):
                    self.commits.files.delete(f"{self.root}/{name}/{own}")
                    gone += 1
        return gone
