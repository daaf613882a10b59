"""Exact deduplication by an extendible-hash index on shared files (DataFrame functions only).

Method. Every text gets a 64-bit hash key. The keys' leading bits choose a bucket
through a directory: it starts with one bucket, and while a bucket holds more
entries than fit, the directory doubles and that bucket is split by one more bit.
Copies are pre-aggregated to one entry for each (key, digest) before any shuffle,
so a group of copies fills one slot however large it is. Owner tasks take ranges
of buckets, one for about OWNED entries, chain the entries of each key (collisions
and copies alike) and write them, ordered, as the index files; that is the only time
entries are dealt. Chains of several rows name the keys whose texts are then compared
byte for byte (grouping by the whole text, partial groups first), so unequal texts
never meet, whatever the hash.

Only texts whose key is shared are shuffled. The directory has at most
2 ** MAX_DEPTH entries: a bucket's capacity grows with the table beyond that, and a
bucket that is still overfull at that depth stays as an overflow chain.

Semantics. A null text is empty. The row with the largest doc_id stays; a null
doc_id is below all others, and a group in which all are null keeps its rows'
null id as keep_id. Rows that repeat a doc_id and its text are the same document:
each gets the same decision. Rows of one doc_id with unlike texts are decided each by
its own text. An empty table gives an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, free_name, table, with_small_side

MAX_DEPTH = 16
#: Entries that a bucket holds at least; it grows so that the directory keeps to MAX_DEPTH.
BUCKET = 2048
#: Entries that an owner task takes.
OWNED = 200_000


def grow_directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Global depth and, for each prefix of so many bits, its bucket.

    ``counts``: entries by their key's first ``max_depth`` bits (2 ** max_depth at most).
    Buckets are numbered in key order.
    """
    depth, leaves = 0, {(0, 0): sum(counts.values())}
    while depth < max_depth:
        overfull = {leaf for leaf, n in leaves.items() if n > capacity and leaf[0] == depth}
        if not overfull:
            break
        depth += 1
        split = {(depth, 2 * prefix + bit): 0 for _, prefix in overfull for bit in (0, 1)}
        for prefix, n in counts.items():
            child = (depth, prefix >> (max_depth - depth))
            if child in split:
                split[child] += n
        leaves = {leaf: n for leaf, n in leaves.items() if leaf not in overfull} | split
    directory = [0] * (1 << depth)
    for bucket, (local, prefix) in enumerate(sorted(leaves, key=lambda x: x[1] << (max_depth - x[0]))):
        first = prefix << (depth - local)
        directory[first : first + (1 << (depth - local))] = [bucket] * (1 << (depth - local))
    return depth, directory


def leading_bits(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


class ExactDedup:
    """The index of a table's texts, and the decision for each row."""

    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", key=F.xxhash64, bucket: int = BUCKET):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "exact")
        body = F.coalesce(F.col(text), F.lit(""))
        self.texts = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("key", key(F.col("body")))
        self.entries = self.scratch.keep(
            self.texts.select("doc_id", "key", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest")), "entries"
        )
        self.index = self._index(bucket)
        self.groups = self._groups()

    def _index(self, bucket: int) -> DataFrame:
        """(bucket, key, digest, rows, keep, chained, head): one entry for all copies, in files by key range.

        ``chained``: rows of all entries of the key; ``head``: whether the entry is the first of its chain.
        """
        spark = self.entries.sparkSession
        chains = self.scratch.keep(
            self.entries.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("keep")), "chains"
        )
        counts = {r[0]: r[1] for r in chains.groupBy(leading_bits(F.col("key"), MAX_DEPTH).alias("p")).count().collect()}
        total = sum(counts.values())
        self.depth, self.directory = grow_directory(counts, max(bucket, math.ceil(total / (1 << (MAX_DEPTH - 2)))))
        n_buckets = self.directory[-1] + 1
        lookup = spark.createDataFrame(list(enumerate(self.directory)), "prefix int, bucket int")
        placed = chains.withColumn("prefix", leading_bits(F.col("key"), self.depth)).join(F.broadcast(lookup), "prefix").drop("prefix")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / OWNED))
        owned = placed.repartitionByRange(max(1, min(n_buckets, tasks)), "bucket", "key")
        chain = Window.partitionBy("bucket", "key")  # the owners' ranges hold it: no other deal
        linked = owned.withColumns({"chained": F.sum("rows").over(chain), "head": F.min("digest").over(chain) == F.col("digest")})
        index = self.scratch.keep(linked.select("bucket", "key", "digest", "rows", "keep", "chained", "head").sortWithinPartitions("bucket", "key", "digest"), "index")
        self.scratch.drop("chains")
        return index

    def _groups(self) -> DataFrame:
        """(key, digest, keep_id, group_size) of texts that several rows have, by comparing bytes."""
        shared = self.index.filter("head AND chained > 1").select("key")
        compared = (
            with_small_side(self.texts, shared, ["key"], "left_semi", shared.count())
            .groupBy("key", "body")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter("group_size > 1")
        )
        return self.scratch.keep(
            compared.select("key", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), "keep_id", "group_size"),
            "groups",
        )

    def decisions(self) -> DataFrame:
        """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
        joined = self.entries.join(self.groups, ["key", "digest"], "left")
        alone = F.col("group_size").isNull()
        keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
        return joined.select(
            "doc_id",
            keep_id.alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of equal texts; rows that repeat a document go too."""
    index = ExactDedup(docs)
    decisions = index.decisions()
    dropped = index.scratch.keep(decisions.filter(~F.col("kept")).select("doc_id", "text_sha256").distinct(), "dropped")
    repeated = index.entries.groupBy("doc_id", "key", "digest").count().filter("count > 1").limit(1).count()
    kept = without_texts(docs, dropped)
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def without_texts(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and text's SHA-256 are in ``dropped``."""
    taken = free_name(docs.columns, "dropped_id")
    digest = free_name([*docs.columns, taken], "dropped_sha256")
    ids = dropped.toDF(taken, digest)
    # an id and its digest take up to four times an id's room
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS // 4 else ids
    own = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return docs.join(side, docs["doc_id"].eqNullSafe(ids[taken]) & (own == ids[digest]), "left_anti")


def op3_exact_dedup(spark, sf_dir):
    return ExactDedup(table(spark, sf_dir, "documents")).decisions()


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
