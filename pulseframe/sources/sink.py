"""The store: Parquet tables that grow by rows they don't have yet.

Importing a batch again adds nothing: rows are known by their hash. Equal hashes have equal times, so a
batch is compared with the months that it touches and no others. An import writes a folder for each table, by
month, and then commits them together (``commits``): readers see all of an import or nothing, an import
that fails leaves nothing behind, and of two writers the later one compares again with what the earlier added.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import utc_second
from ..operators.dedup import best_source, real_steps
from ..schema import IMPORT_RUNS, KEYS, TABLES
from .commits import Commits, Conflict
from .identity import HASHES, parent_hash

#: What tells a row's month (in UTC), of tables in which it is part of what makes a row one row.
TIMES = {"records": "start_ts", "sleep": "start_ts", "workouts": "start_ts", "workout_events": "workout_start_ts", "activity_summary": "date"}
MONTH = "month"
#: How the store's files are packed: hashes are half their text's size.
PACKED = "zstd"
#: Rows of a batch up to which their keys are broadcast to the table, which then isn't shuffled.
FEW_ROWS = 100_000


def new_rows(batch: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch, one for each key, whose key the table lacks. The table is read for its keys alone.

    Of several rows with one key the least stays, by their columns in order. Rows and known keys meet in one
    grouping, so a row is shuffled once.
    """
    rest = [c for c in batch.columns if c not in keys]
    told = batch.select(*keys, F.struct(*rest).alias("_row"), F.lit(False).alias("_known"))
    known = table.select(*keys, F.lit(None).cast(told.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_known"))
    one = told.unionByName(known).groupBy(*keys).agg(F.min("_row").alias("_row"), F.max("_known").alias("_known"))
    return one.filter("NOT _known").select(*keys, "_row.*").select(*batch.columns)


def among(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the table whose key a small batch has."""
    own = batch.select(*(F.col(k).alias(f"_own_{k}") for k in keys))
    return table.join(F.broadcast(own), reduce(and_, (F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in keys)), "left_semi")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, self.root)
        self.files = self.commits.files

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def state(self) -> dict:
        """What the newest commit says: for each table its folders, with how many rows each has, and where streams are."""
        return self.commits.latest()

    def rows(self, name: str, state: dict | None = None) -> int:
        return sum(n for _, n in (state or self.state())["tables"].get(name, []))

    def _held(self, name: str, state: dict) -> DataFrame:
        """The table with its month."""
        schema = T.StructType([*TABLES[name].fields, *([T.StructField(MONTH, T.StringType())] if name in TIMES else [])])
        folders = [self.path(folder) for folder, _ in state["tables"].get(name, [])]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(name)).parquet(*folders).drop("import")

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        return self._held(name, state or self.state()).select(*TABLES[name].names)

    def _fresh(self, name: str, parsed: DataFrame, size: int, state: dict, own: str) -> tuple[str, int]:
        """Writes what of ``parsed`` the table lacks to a folder of its own; that folder and its rows."""
        held, folders = self._held(name, state), []
        if name in TIMES:
            held, folders = held.filter(F.col(MONTH).isin([r[0] for r in parsed.select(MONTH).distinct().collect()])), [MONTH]  # a value for each month
        if size <= FEW_ROWS:
            held = among(held, parsed, KEYS[name])
        seen, folder = Observation(), f"{name}/import={own}"
        new_rows(parsed, held, KEYS[name]).observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*folders).parquet(self.path(folder), compression=PACKED)
        return folder, seen.get["rows"]

    def _parsed(self, name: str, batch: DataFrame, own: str) -> tuple[DataFrame, int]:
        """The batch in the table's columns and its rows, written once: months and rows are taken from it, not from its source again."""
        batch = batch.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[name].fields))
        if name in TIMES:
            at = F.col(TIMES[name])
            month = F.substring(at if name == "activity_summary" else utc_second(at), 1, 7)
            batch = batch.withColumn(MONTH, F.coalesce(month, F.lit("none")))
        seen = Observation()
        batch.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(self.path(f"_parsed/{own}/{name}"), compression=PACKED)
        return self.spark.read.schema(batch.schema).parquet(self.path(f"_parsed/{own}/{name}")), seen.get["rows"]

    def add(self, name: str, batch: DataFrame) -> int:
        """Appends what is new to one table; how many rows that was."""
        return self._commit({name: batch}, None, None)[name]

    def ingest(self, frames: dict[str, DataFrame], archive: str = "", subject: str = "", run: tuple[str, int] | None = None) -> dict[str, int]:
        """Adds one import's frames (by table, as the sources give them) and records the run, all in one commit; rows added by table.

        ``run`` is a stream's name and the number of its batch: a number that is committed already adds nothing.
        """
        return self._commit({name: hashed(name, frame, subject) for name, frame in frames.items()}, archive, run)

    def _commit(self, frames: dict[str, DataFrame], archive: str | None, run: tuple[str, int] | None, tries: int = 10) -> dict[str, int]:
        own = uuid.uuid4().hex
        try:
            parsed = None
            for turn in range(tries):
                state = self.state()
                if run is not None and state["streams"].get(run[0], -1) >= run[1]:
                    return dict.fromkeys(frames, 0)
                parsed = parsed or {name: self._parsed(name, frame, own) for name, frame in frames.items()}
                added, written = {}, []
                try:
                    for name, (frame, size) in parsed.items():
                        folder, added[name] = self._fresh(name, frame, size, state, f"{own}-{turn}")
                        written.append(folder)
                        if added[name]:
                            state["tables"].setdefault(name, []).append([folder, added[name]])
                    if archive is not None:
                        totals = [self.rows(t, state) for t in ("records", "workouts", "sleep")]
                        row = self.spark.createDataFrame([(archive, *totals)], "archive_name string, records_total long, workouts_total long, sleep_total long")
                        folder = f"import_runs/import={own}-{turn}"
                        row.withColumn("imported_at", F.current_timestamp()).select(*IMPORT_RUNS.names).write.parquet(self.path(folder))
                        written.append(folder)
                        state["tables"].setdefault("import_runs", []).append([folder, 1])
                    if run is not None:
                        state["streams"][run[0]] = run[1]
                    self.commits.commit(state | {"version": state["version"] + 1})
                except Exception as why:
                    for folder in written:
                        self.files.delete(self.path(folder))
                    if isinstance(why, Conflict):
                        continue
                    raise
                for folder in written:
                    if folder.partition("/")[0] in added and not added[folder.partition("/")[0]]:
                        self.files.delete(self.path(folder))
                return added
            raise Conflict(f"{tries} commits of others came first")
        finally:
            self.files.delete(self.path(f"_parsed/{own}"))

    def compact(self, most: int = 8, small: int = 20_000_000) -> dict[str, int]:
        """Merges a table's folders of fewer than ``small`` rows where there are more than ``most``; folders merged by table.

        Imports may commit meanwhile: only the merged folders are replaced. The old ones stay for readers until ``vacuum``.
        """
        merged, own = {}, uuid.uuid4().hex
        for name in TABLES:
            state = self.state()
            old = [entry for entry in state["tables"].get(name, []) if entry[1] < small]
            if len(old) <= most:
                continue
            folders = [MONTH] if name in TIMES else []
            rows = self._held(name, {"tables": {name: old}}).hint("rebalance", *folders)
            rows.write.partitionBy(*folders).parquet(self.path(f"{name}/import={own}"), compression=PACKED)
            replaced = {folder for folder, _ in old}
            for _ in range(10):
                state = self.state()
                kept = [entry for entry in state["tables"][name] if entry[0] not in replaced]
                if len(kept) + len(old) != len(state["tables"][name]):
                    raise Conflict(f"{name} was merged by another")
                state["tables"][name] = [[f"{name}/import={own}", sum(n for _, n in old)], *kept]
                try:
                    self.commits.commit(state | {"version": state["version"] + 1})
                    merged[name] = len(old)
                    break
                except Conflict:
                    continue
        return merged

    def replace(self, name: str, folder: str, rows: int, since: int) -> None:
        """Makes ``folder`` the whole of a table; Conflict if the table has changed since that version."""
        for _ in range(10):
            state = self.state()
            if state["tables"].get(name) != self.commits.at(since)["tables"].get(name):
                raise Conflict(f"{name} has changed since version {since}")
            state["tables"][name] = [[folder, rows]]
            try:
                return self.commits.commit(state | {"version": state["version"] + 1})
            except Conflict:
                continue
        raise Conflict("commits of others came first")

    def vacuum(self, versions: int = 1) -> list[str]:
        """Deletes folders that none of the last ``versions`` commits names; those folders. Run it while nothing imports."""
        known = self.commits.versions()[-versions:]
        named = {folder for v in known for entries in self.commits.at(v)["tables"].values() for folder, _ in entries}
        gone = [f"{name}/{own}" for name in TABLES for own in self.files.names(self.path(name)) if f"{name}/{own}" not in named]
        for folder in gone:
            self.files.delete(self.path(folder))
        return gone

    def views(self) -> dict[str, DataFrame]:
        """The tables of one commit, and the two that hide copies; registered as temporary views for SQL."""
        state = self.state()
        found = {name: self.read(name, state) for name in TABLES}
        found |= {"records_dedup": best_source(found["records"]), "workout_events_dedup": real_steps(found["workout_events"])}
        for name, frame in found.items():
            frame.createOrReplaceTempView(name)
        return found


def alone():
    return F.coalesce("subject_id", F.lit("")) == ""


def hashed(name: str, frame: DataFrame, subject: str = "") -> DataFrame:
    """``frame`` with its identity, its link to a parent, and the athlete ("" where there is one only)."""
    if "subject_id" not in frame.columns:
        frame = frame.withColumn("subject_id", F.lit(subject))
    if name == "workout_events":
        frame = frame.withColumn("workout_hash", parent_hash())
    if name in HASHES:
        own = HASHES[name]()
        # with several athletes in one store the same reading of two is two rows
        frame = frame.withColumn("row_hash", F.when(alone(), own).otherwise(F.md5(F.concat_ws("|", F.col("subject_id"), own))))
        if name == "workout_events":
            frame = frame.withColumn("workout_hash", F.when(alone(), F.col("workout_hash")).otherwise(F.md5(F.concat_ws("|", F.col("subject_id"), F.col("workout_hash")))))
    return frame


def verify(table: DataFrame, name: str) -> dict[str, int]:
    """Rows whose stored hash isn't the one of their fields, links that differ, and keys held twice."""
    stored = table.withColumn("_stored", F.col("row_hash"))
    stored = stored.withColumn("_link", F.col("workout_hash") if name == "workout_events" else F.lit(None).cast("string"))
    marked = hashed(name, stored)
    wrong = F.sum((~F.col("row_hash").eqNullSafe(F.col("_stored"))).cast("long"))
    link = F.sum((~F.col("workout_hash").eqNullSafe(F.col("_link"))).cast("long")) if name == "workout_events" else F.lit(0)
    row = marked.agg(F.coalesce(wrong, F.lit(0)).alias("wrong"), F.coalesce(link, F.lit(0)).alias("link")).first()
    twice = table.groupBy("row_hash").count().filter("count > 1").count()
    return {"wrong_hash": row["wrong"], "wrong_link": row["link"], "duplicate_keys": twice}
