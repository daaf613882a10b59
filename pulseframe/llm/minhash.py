"""Near-duplicate documents by bottom-k sketches from one hash function.

Method. A document's set is its distinct 5-word shingles, hashed to 64 bits; its
sketch is the K smallest hashes. Documents of equal sets form a class, named by a
128-bit signature of the set, which goes on as one. Inverted lists of retained values
say which classes overlap; the union-sketch estimate (matches among the K smallest
values of both sketches together) filters pairs; the exact Jaccard similarity of the
full sets verifies what is left.

Lists of sketch values. Two sets of similarity >= 0.85 share at least ``needed``
retained values (certain for sets of up to K; for larger sets the chance of fewer is
1.5e-7 at 0.85). So each class is listed under all but the ``needed - 1`` most frequent
of its values, and values of common passages cost nothing. A class that meets nobody in
these lists has no partner.

Lists of all values. Classes that meet somebody are listed once more, by their full
sets, from the rarest shared value on; a value's place counts those before it, values of
one class alone first. That is exact at any size: of two sets with n and m shingles,
linked ones share (n + m) * 85 / 185 at least, so at their first common value at
most n - that + 1 places are behind either of them. A copy with many edits has many values
that no other class has; they fill its places, so it meets nobody, as it must.

Pairs. No list is paired off. Each member meets only the list's hub, the class with the
fewest values of its own, which stands nearest to what the list has in common. Linked
classes are labelled by component; in lists that still span several, the members outside
the largest component whose places allow any partner of the sizes there are compared, and
only at places that allow that very pair. So the work grows with the lists' lengths plus
the pairs that are nearly linked.

Components are labelled by hooking and pointer jumping over tables in the shared
folder; nothing but counts reaches the driver.

Semantics. A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; fewer than five words
make one shingle of all; a text without words (or null) has an empty set and is
linked with nothing. Links need 100 * intersection >= 85 * union. Every row is decided by
its own text, also if several rows have one doc_id. A null doc_id is above all others: its
row belongs to its text's component, and component_id is null only where all of a
component's are. Of each component the stage keeps one row, that with the smallest doc_id,
then text digest; of rows that repeat both, one. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, Scratch, pieces, table, texts_of, utf8
from .exact_dedup import without_texts

SHINGLE = 5
K = 24
#: Retained values that linked documents with more than K shingles share at least.
NEEDED = 10
#: Part of the union sketch that must match for a pair to be verified: 10 of 24.
ESTIMATE = 0.4
_MULTIPLIERS = np.array([(xxhash.xxh3_64_intdigest(b"shingle %d" % i) | 1) for i in range(SHINGLE)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64's shifts and multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_of(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = utf8(text).lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    if n < SHINGLE:
        return mixed(np.array([(h * _MULTIPLIERS[:n]).sum() + np.uint64(n)], dtype=np.uint64))
    total = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
    for i in range(SHINGLE):
        total += h[i : n - SHINGLE + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mixed(total))


def signature_of(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_shingles, signature of the set, and the K smallest hashes in order."""
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("digest", T.BinaryType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("signature", T.BinaryType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        for batch in pieces(batches, "text"):
            sizes, signatures, sketches = [], [], []
            for text in texts_of(batch, "text"):
                own = set_of(text)
                sizes.append(len(own))
                signatures.append(signature_of(own))
                sketches.append(own[:K].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return docs.select("doc_id", "digest", "text").mapInArrow(run, schema)


def full_sets(texts: DataFrame) -> DataFrame:
    """(signature, hashes) of each row's text."""

    def run(batches):
        for batch in pieces(batches, "text"):
            sets = [set_of(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(signature_of, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["signature", "hashes"]
            )

    return texts.select("text").mapInArrow(run, "signature binary, hashes array<long>")


def needed(n):
    """Values that the sketch of a set of ``n`` shares with that of any linked set, at least."""
    return F.when(n <= K, F.greatest(F.lit(1), F.floor(n * F.lit(0.82)))).otherwise(F.lit(NEEDED)).cast("int")


def common(n, m):
    """Values that linked sets of ``n`` and ``m`` share at least."""
    return F.floor(((n + m) * 85 + 184) / 185)


def largest_partner(n, place):
    """The most shingles that a partner has which shares no value before ``place`` with a set of ``n``."""
    return F.floor((n - place + 1) * 185 / 85) - n


def may_meet(n, place, m, at):
    """Whether sets of ``n`` and ``m`` can be linked if a common value has these places and none is before."""
    return (F.least(n - place, m - at) + 1 >= common(n, m)) & (100 * F.least(n, m) >= 85 * F.greatest(n, m))


def estimate(a, b):
    """Share of matches in the K smallest values of the union of two sketches, or of all if there are fewer."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


class NearDuplicates:
    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id"):
        self.scratch = Scratch(docs.sparkSession, "near")
        body = F.coalesce(F.col(text), F.lit(""))
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("text"))
        self.rows = self.scratch.keep(sketched(self.docs), "rows")
        self.classes = self.scratch.keep(
            self.rows.filter("n_shingles > 0")
            .groupBy("signature")
            .agg(F.min("doc_id").alias("id"), F.min(F.struct("digest", "doc_id")).alias("one"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
            "classes",
        )
        self.links = self._links()

    def _ranked(self, sets: DataFrame, name: str) -> DataFrame:
        """(signature, n, value, place, lone): values that several sets have, placed by rarity from 1.

        ``sets``: signature, n (size of the full set) and its values. Values of one set alone, ``lone`` in number, take the first places.
        """
        postings = sets.select("signature", "n", F.size("values").alias("size"), F.explode("values").alias("value"))
        postings = self.scratch.keep(postings, f"{name}_postings")
        frequency = postings.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
        frequency = self.scratch.keep(frequency, f"{name}_frequency")
        per_set = (
            postings.join(frequency, "value")
            .groupBy("signature")
            .agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("shared"))
        )
        placed = per_set.select("signature", "n", (F.col("size") - F.size("shared")).alias("lone"), F.posexplode("shared").alias("at", "entry"))
        return placed.select("signature", "n", F.col("entry.value").alias("value"), (F.col("lone") + F.col("at") + 1).alias("place"), "lone")

    def _overlapping(self) -> DataFrame:
        """(digest, doc_id) of a text of each class that meets another in the lists of sketch values."""
        size = F.least(F.col("n"), F.lit(K))
        ranked = self._ranked(self.classes.select("signature", "n", F.col("sketch").alias("values")), "wide")
        members = self.scratch.keep(ranked.filter(F.col("place") <= size - needed(F.col("n")) + 1).select("value", "signature"), "wide_members")
        lists = members.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("value")
        met = members.join(lists, "value").select("signature").distinct()
        return self.scratch.keep(self.classes.join(met, "signature", "left_semi").select("one.digest", "one.doc_id"), "overlapping")

    def _sets(self) -> DataFrame:
        """(signature, hashes) of the overlapping classes."""
        ones = self._overlapping().toDF("one_digest", "one_id")
        few = ones.count() <= BROADCAST_IDS // 4  # a digest takes up to four times an id's room
        at = (F.col("digest") == F.col("one_digest")) & F.col("doc_id").eqNullSafe(F.col("one_id"))
        held = self.docs.join(F.broadcast(ones) if few else ones, at, "left_semi").dropDuplicates(["digest"])
        return self.scratch.keep(full_sets(held), "sets")

    def _verified(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that pass the estimate and whose full sets are similar enough."""
        sketches = self.classes.select("signature", "sketch")
        near = pairs.join(sketches.toDF("a", "s_a"), "a").join(sketches.toDF("b", "s_b"), "b")
        near = self.scratch.keep(near.filter(estimate(F.col("s_a"), F.col("s_b")) >= ESTIMATE).select("a", "b"), f"{name}_near")
        both = F.size(F.array_intersect("of_a", "of_b"))
        either = F.size("of_a") + F.size("of_b") - both
        found = near.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b").filter(100 * both >= 85 * either).select("a", "b")
        return self.scratch.keep(found, f"{name}_links")

    def _hub_pairs(self, members: DataFrame) -> DataFrame:
        """Each member with the hub of each of its lists, if their places allow a link."""
        hub = F.min_by(F.struct(F.col("signature").alias("b"), F.col("n").alias("m"), F.col("place").alias("at")), F.struct("lone", "signature"))
        hubs = members.groupBy("value").agg(hub.alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("value", "hub.*")
        hubs = self.scratch.keep(hubs, "hubs")
        met = members.join(hubs, "value").filter("signature != b").filter(may_meet(F.col("n"), F.col("place"), F.col("m"), F.col("at")))
        return self.scratch.keep(met.select(F.least("signature", "b").alias("a"), F.greatest("signature", "b").alias("b")).distinct(), "hub_pairs")

    def _rest(self, members: DataFrame, component: DataFrame) -> DataFrame:
        """Pairs of unlike components whose places allow a link, in lists that span several."""
        labelled = members.join(component.withColumnRenamed("id", "signature"), "signature", "left")
        labelled = self.scratch.keep(labelled.withColumn("component", F.coalesce("component", "signature")), "labelled")
        parts = labelled.groupBy("value", "component").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"))
        lists = parts.groupBy("value").agg(F.max_by("component", F.struct("members", "component")).alias("largest"), F.count(F.lit(1)).alias("parts"), F.min("least").alias("least"))
        lists = self.scratch.keep(lists.filter("parts > 1").select("value", "largest", "least"), "open")
        viable = labelled.join(lists, "value").filter(largest_partner(F.col("n"), F.col("place")) >= F.col("least"))
        viable = self.scratch.keep(viable.select("value", "signature", "n", "place", "component", "largest"), "viable")
        x = viable.filter("component != largest").select("value", F.col("signature").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("at_a"), F.col("component").alias("of_a"))
        y = viable.select("value", F.col("signature").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("at_b"), F.col("component").alias("of_b"), "largest")
        met = x.join(y, "value").filter("of_a != of_b AND (of_b = largest OR a < b)")
        met = met.filter(may_meet(F.col("n_a"), F.col("at_a"), F.col("n_b"), F.col("at_b")))
        return self.scratch.keep(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    def _links(self) -> DataFrame:
        sets = self._sets()
        n = F.col("n")
        members = self._ranked(sets.select("signature", F.size("hashes").alias("n"), F.col("hashes").alias("values")), "deep")
        members = self.scratch.keep(members.filter(F.col("place") <= n - F.ceil(n * 85 / 100) + 1), "members")
        links = self._verified(self._hub_pairs(members), sets, "hub")
        rest = self._rest(members, components(self.scratch, links, "early"))
        links = self.scratch.keep(links.unionByName(self._verified(rest, sets, "rest")), "links")
        self.scratch.drop("wide_postings", "wide_frequency", "wide_members", "deep_postings", "deep_frequency", "sets", "members", "labelled", "viable")
        return links

    def decisions(self) -> DataFrame:
        """doc_id, digest, n_shingles, component (of signatures), component_id for each row."""
        component = components(self.scratch, self.links, "final").withColumnRenamed("id", "signature")
        linked = self.scratch.keep(component.join(self.classes.select("signature", "id"), "signature"), "linked")
        least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
        of_linked = linked.select("signature", "component").join(least, "component")
        of_class = self.classes.select("signature", "id").join(of_linked, "signature", "left")
        of_class = self.scratch.keep(
            of_class.select("signature", F.coalesce("component", "signature").alias("component"), F.coalesce("component_id", "id").alias("component_id")), "labels"
        )
        out = self.rows.select("doc_id", "digest", "n_shingles", "signature").join(of_class, "signature", "left")
        label = F.when(F.col("signature").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return out.select("doc_id", "digest", "n_shingles", "component", label.alias("component_id"))

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for each row."""
        same = F.col("doc_id").eqNullSafe(F.col("component_id"))
        return self.decisions().select("doc_id", "n_shingles", "component_id", same.alias("kept"))


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(id, component) of all linked ids: the smallest id that each reaches.

    Every round each tree of parents is hooked onto the smallest grandparent that a
    link shows it, and then halves its depth; rounds grow with the logarithm of the
    longest path.
    """
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}_edges")
    parents = scratch.keep(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p")), f"{name}_0")
    at = 0
    while True:
        up = parents.select(F.col("id").alias("p"), F.col("p").alias("g"))
        grand = scratch.keep(parents.join(up, "p").select("id", "p", "g"), f"{name}_g{at}")
        seen = both.join(grand.select(F.col("id").alias("b"), F.col("g").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = grand.join(seen.withColumnRenamed("a", "id"), "id").select("id", "p", F.least("g", "near").alias("best"))
        offers = hooked.select("id", F.col("best").alias("p")).unionByName(hooked.select(F.col("p").alias("id"), F.col("best").alias("p")))
        after = scratch.keep(offers.groupBy("id").agg(F.min("p").alias("p")), f"{name}_{at + 1}")
        moved = after.join(parents.withColumnRenamed("p", "old"), "id").filter("p != old").limit(1).count()
        scratch.drop(f"{name}_g{at}", f"{name}_{at}")
        parents, at = after, at + 1
        if not moved:
            return parents.withColumnRenamed("p", "component")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; texts without words all stay."""
    near = NearDuplicates(docs)
    rows = near.scratch.keep(near.decisions().filter("component IS NOT NULL").select("doc_id", "digest", "component"), "decided")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    several = near.scratch.keep(first.filter("rows > 1").select("component", "stays"), "stays")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("digest") == F.col("stays.digest"))
    judged = near.scratch.keep(rows.join(several, "component").select("doc_id", F.lower(F.hex("digest")).alias("sha256"), stays.alias("kept")), "judged")
    kept = without_texts(docs, judged.filter("NOT kept").select("doc_id", "sha256").distinct())
    repeated = judged.filter("kept").groupBy("doc_id", "sha256").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def op1_minhash(spark, sf_dir):
    return NearDuplicates(table(spark, sf_dir, "documents")).result()
