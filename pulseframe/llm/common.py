"""Shared plumbing of the training-data operators: scratch tables, size-checked joins, batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a narrow id (8 bytes and its hash entry) that may be broadcast: 64 MB at most.
BROADCAST_IDS = 1_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may run without that setting; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _local:
        _local[own] = "file://" + tempfile.mkdtemp(prefix="pulseframe-")
    return _local[own]


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables in the shared folder, which cut lineage and outlive lost executors.

    A table lives until ``drop`` or the end of the process: results that are
    still lazy may read it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pulseframe-{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.path(name))

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.root)
        except Exception:  # the JVM is gone already; the cluster's cleaner removes the folder
            pass


def with_small_side(docs: DataFrame, keys: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Semi or anti join with ``keys``, of which there are ``rows`` narrow rows.

    Up to BROADCAST_IDS rows the keys are broadcast and ``docs`` stays where it
    is; beyond that both sides are shuffled.
    """
    return docs.join(F.broadcast(keys) if rows <= BROADCAST_IDS else keys, on, how)


#: Keys that hold at least one row in so many; there are no more of them than that.
HOT_SHARE = 1000


def join_apart(rows: DataFrame, keys: DataFrame, on: list[str], size: str) -> DataFrame:
    """Inner join with distinct ``keys``, of which ``size`` tells how many of ``rows`` each has.

    Keys of a thousandth of these rows or more, a thousand at most, are broadcast and their rows stay where
    they are, so no key is one task's work; the rest is shuffled.
    """
    total = keys.agg(F.sum(size)).first()[0] or 0
    hot, cool = (keys.filter(c).drop(size) for c in (F.col(size) * HOT_SHARE >= total, F.col(size) * HOT_SHARE < total))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cool, on))


def marked_apart(rows: DataFrame, keys: DataFrame, on: list[str], size: str, mark: str) -> DataFrame:
    """``rows`` with a boolean ``mark``: whether ``keys`` has their key. Dealt as in ``join_apart``."""
    total, own = keys.agg(F.sum(size)).first()[0] or 0, free_name([*rows.columns, mark], "own")
    hot, cool = (keys.filter(c).select(*on, F.lit(True).alias(own)) for c in (F.col(size) * HOT_SHARE >= total, F.col(size) * HOT_SHARE < total))
    near = rows.join(F.broadcast(hot), on, "left")
    found, rest = near.filter(F.col(own)), near.filter(F.col(own).isNull()).drop(own)
    rest = rest.join(cool, on, "left")
    both = found.unionByName(rest)
    return both.withColumn(mark, F.coalesce(F.col(own), F.lit(False))).drop(own)


def lower_ascii(column):
    """A-Z to a-z; other letters stay."""
    return F.translate(column, UPPER, LOWER)


def crc_mod(column, n: int):
    """crc32 of an id as text, modulo n. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def free_name(taken, wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (case ignored)."""
    taken = {c.lower() for c in taken}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


#: Bytes of text that a model is fitted on at most.
SAMPLE_BYTES = 64 << 20


def sample_texts(docs: DataFrame, chosen: DataFrame, scratch: Scratch, most: int = SAMPLE_BYTES) -> list:
    """Rows (the columns of ``chosen``, body) to fit on, at most one for each row of ``chosen``, with ``most`` bytes of text in all.

    ``chosen`` has distinct rows with a doc_id, as many as a sample may have; ``docs`` has doc_id and body. Of several
    rows of one doc_id the least text counts. Texts are taken in the order of the ids' hashes while they fit
    into ``most``; one that doesn't is left out. Sizes are looked at first, so nothing larger reaches the driver.
    """
    joined = docs.join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min("body").alias("body"))
    held = scratch.keep(joined.withColumn("size", F.octet_length("body")).withColumn("place", F.xxhash64("doc_id")), "sample")
    sizes = sorted((tuple(r) for r in held.select("place", *chosen.columns, "size").collect()), key=lambda r: r[:-1])
    taken, left = [], most
    for row in sizes:
        if row[-1] <= left:
            left -= row[-1]
            taken.append(row[1:-1])
    if len(taken) < len(sizes):
        held = held.join(F.broadcast(docs.sparkSession.createDataFrame(taken, chosen.schema)), chosen.columns, "left_semi")
    found = held.select(*chosen.columns, "body").collect()
    scratch.drop("sample")
    return found


#: Bytes of rows that the JVM hands to a Python worker at a time.
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches small: their buffers lie in the JVM and the worker, beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Bytes of text that a Python worker holds as objects at a time.
PIECE_BYTES = 4 << 20


def pieces(batches, column: str, most: int = PIECE_BYTES):
    """The batches in slices of about ``most`` bytes of a text column, or of one longer text; empty batches are left out."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        begin = held = 0
        for at, size in enumerate(sizes):
            if at > begin and held + size > most:
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def record_batches(rows, schema: pa.Schema, most_rows: int = 2000, most: int = PIECE_BYTES):
    """Tuples as Arrow batches, of so many rows or about so many bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most_rows or size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def positions(df: DataFrame, order: list, scratch: Scratch, name: str) -> tuple[DataFrame, str]:
    """``df`` with each row's place (from 0) in the whole order, and that column's name.

    One sort by ranges; what reaches the driver is a number for each range. Rows that tie
    in all of ``order`` stand in any order, and are dealt to ranges apart by a last key.
    """
    place, own = free_name(df.columns, "place"), free_name([*df.columns, "place"], "own")
    apart = F.xxhash64(F.monotonically_increasing_id()) if df.columns else F.lit(0)
    keyed = df.withColumn(own, apart)
    sorted_ = keyed.repartitionByRange(*order, F.col(own)).sortWithinPartitions(*order, F.col(own)).withColumn(own, F.monotonically_increasing_id())
    kept = scratch.keep(sorted_, name)
    part = F.shiftright(F.col(own), 33)
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for at, n in sizes:
        rows.append((at, before))
        before += n
    number = free_name([*kept.columns, place], "part")
    begin = free_name([*kept.columns, place, number], "begin")
    starts = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(number, T.LongType()), T.StructField(begin, T.LongType())]))
    joined = kept.join(F.broadcast(starts), part == F.col(number))
    return joined.withColumn(place, F.col(begin) + F.col(own).bitwiseAND(F.lit((1 << 33) - 1))).drop(number, begin, own), place


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")
