"""Language-model scores by context-tree weighting over bytes.

Model. A text is its bytes after A-Z is lower-cased, then an end mark; a byte is eight
binary decisions, and each of the 255 nodes of that decomposition has a context tree
over the DEPTH bytes before (an end mark where the text hasn't begun). Every node
estimates its bit by Krichevsky-Trofimov; a context's weighted probability is half its
own estimate and half the product of its longer contexts' weighted probabilities. A
text is scored by the weights that all training documents give: the prediction mixes
the estimates of all depths, each by its share of the weighted probability.

Work. Text is dealt to blocks of about BLOCK_BYTES. A block gathers its distinct
(context, byte) strings and words with their training counts. Contexts that share their
last two bytes belong to one of PARTS parts; a block's strings of one part travel as one
row, sorted and packed. The task that holds a part adds up what the blocks counted and
weights its trees from the deepest up; what they give to depth 1 and 0 (256 x 255 nodes
at most) is finished on the driver and sent back. Then each block gets the log
probabilities and counts of its own strings and words, no more, and scores its documents
as they stream by. So nothing that grows with the corpus is broadcast or collected. The
largest task holds the distinct strings of the commonest two bytes (a fiftieth of all).

Semantics. Training documents are those whose crc32(doc_id as text) mod 7 is not 2. A
null text is empty: it has the end mark alone. A text of more than CHUNK_BYTES is taken in stretches of
so many bytes, each with the DEPTH bytes before it. Rows that repeat a document count each.
Without training documents every bit has probability 1/2 and base_score is that of
unseen tokens. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, crc_mod, small_batches, table, texts_of, utf8

DEPTH = 6
BLOCK_BYTES = 32_000_000
#: Groups of contexts by their last two bytes.
PARTS = 512
#: Bytes of text that are taken apart at once: some 60 times as many bytes of arrays.
CHUNK_BYTES = 2 << 20
END = 255
HELD_OUT = 2
_NODES = 1 << 16


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series at x + 8, and back by the recurrence."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    z = x + 8
    square = z * z
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * square)) / square) / square) / square) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log probability of n0 zeros and n1 ones by Krichevsky-Trofimov."""
    big = np.maximum(n0, n1)
    with np.errstate(over="ignore"):
        return np.where(big == 0, 0.0, lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi))


def kt_bit(n0: np.ndarray, n1: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)


def grams_of(bodies: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) strings of all texts, packed into integers, and how many each text has."""
    pad = bytes([END]) * depth
    codes = np.frombuffer(b"".join(pad + b + bytes([END]) for b in bodies), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(b) + 1 for b in bodies], dtype=np.int64)
    packed = np.zeros(max(0, len(codes) - depth), dtype=np.int64)
    for k in range(depth + 1):
        packed = (packed << 8) | codes[k : k + len(packed)]
    inside = np.ones(len(packed) + depth, dtype=bool)
    ends = np.cumsum(sizes + depth)
    for k in range(1, depth + 1):
        inside[ends - k] = False
    return packed[inside[: len(packed)]], sizes


def gram_stretches(body: bytes, depth: int = DEPTH, most: int | None = None):
    """``grams_of`` one text, ``most`` of them at a time: a text of any length takes no more memory than that and itself."""
    most = most or CHUNK_BYTES
    whole = bytes([END]) * depth + body + bytes([END])
    for begin in range(0, len(body) + 1, most):
        codes = np.frombuffer(whole, dtype=np.uint8, offset=begin, count=min(most, len(body) + 1 - begin) + depth)
        packed = np.zeros(len(codes) - depth, dtype=np.int64)
        for k in range(depth + 1):
            packed = (packed << 8) | codes[k : k + len(packed)]
        yield packed


def chunked(sizes: list[int], most: int = CHUNK_BYTES):
    """Ranges of consecutive texts of about ``most`` bytes together, or of one longer text."""
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > most:
            yield begin, at
            begin, held = at, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def packed(values: np.ndarray) -> bytes:
    """Eight-byte numbers by their bytes' places, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(body: bytes, size: int, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(body, decompressed_size=8 * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    return packed(np.diff(keys, prepend=0))


def unpacked_keys(body: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpacked(body, size))


def part_of(grams: np.ndarray) -> np.ndarray:
    return (((grams >> 8) & 0xFFFF) * 40503 >> 3) % PARTS


class Counts:
    """Sums of counts by number; what is added waits until it is as much as what is there."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((keys, n))
        self.size += len(keys)
        if self.size > max(len(self.keys), 1 << 20):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys, n = (np.concatenate(x) for x in zip((self.keys, self.n), *self.waiting, strict=True))
            self.waiting, self.size = [], 0
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            self.keys, self.n = keys[first], np.add.reduceat(n, first) if len(first) else n
        return self.keys, self.n


class Trees:
    """Weighted context trees of depth ``depth`` down to 2 for distinct (context, byte) strings, of which those that share their last two context bytes are all here.

    ``strings`` has, from the deepest depth up, the distinct (context, byte) strings of that
    depth in ascending order, their counts, and where the strings of the depth below lie in
    it. Strings whose bytes share their leading bits are neighbours, so each level of the
    decomposition is a run over the same order; levels are made one at a time.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.grams, n = grams, counts.astype(np.float64)
        keys, slot = np.unique(grams, return_inverse=True)
        n = np.bincount(slot, n, len(keys))
        self.strings = [(keys, n, slot)]
        for d in range(depth - 1, 1, -1):
            keys, slot = np.unique(keys & ((1 << (8 * (d + 1))) - 1), return_inverse=True)
            n = np.bincount(slot, n, len(keys))
            self.strings.append((keys, n, slot))

    def level(self, level: int):
        """For each depth from the deepest: zeros, ones, log weighted probability and own share of each node, node of each string, first string of each node; and what the nodes of depth 2 are."""
        made, below = [], None
        for keys, n, slot in self.strings:
            first = np.flatnonzero(np.diff(keys >> (8 - level), prepend=-1))
            node = np.zeros(len(keys), dtype=np.int64)
            node[first[1:]] = 1
            node = np.cumsum(node)
            bit = (keys >> (7 - level)) & 1
            ones = np.add.reduceat(n * bit, first)
            zeros = np.add.reduceat(n, first) - ones
            own = kt_block(zeros, ones)
            if below is None:
                weighted, weight = own, np.ones(len(first))
            else:
                rest = np.bincount(node[slot[made[-1][5]]], below, len(first))
                weighted = np.logaddexp(own, rest) - math.log(2)
                weight = np.exp(own - math.log(2) - weighted)
            made.append((zeros, ones, weighted, weight, node, first))
            below = weighted
        at = keys[first]
        return made, (((at >> 8) & 255) << 8) | (1 << level) | ((at & 255) >> (8 - level))

    def upward(self):
        """For depth 1: (last byte and decomposition node) as one number, zeros, ones, sum of the log weighted probabilities."""
        parts = []
        for level in range(8):
            made, node = self.level(level)
            zeros, ones, below, *_ = made[-1]
            own, slot = np.unique(node, return_inverse=True)
            parts.append((own, *(np.bincount(slot, x, len(own)) for x in (zeros, ones, below))))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def log10(self, top: Top) -> np.ndarray:
        """log10 probability of each string's byte after its context."""
        keys, _, slot = self.strings[0]
        total = np.zeros(len(keys))
        for level in range(8):
            made, at = self.level(level)
            # from depth 2 down: probability of each bit by the depths so far, and the share of those below
            p0, p1, passed = top.zeros[at], top.ones[at], top.passed[at]
            for d in range(len(made) - 1, -1, -1):
                zeros, ones, _, weight, _, first = made[d]
                if d < len(made) - 1:
                    parent = made[d + 1][4][self.strings[d + 1][2][first]]
                    p0, p1, passed = p0[parent], p1[parent], passed[parent]
                share = passed * weight / (zeros + ones + 1.0)
                p0, p1, passed = p0 + share * (zeros + 0.5), p1 + share * (ones + 0.5), passed * (1 - weight)
            node = made[0][4]
            total += np.log10(np.where((keys >> (7 - level)) & 1, p1[node], p0[node]))
        return total[slot]


class Top:
    """Depths 1 and 0: probability of a bit = zeros or ones + passed * (probability by depths 2 and more)."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        zeros, ones, rest = (np.bincount(node, x, _NODES) for x in (n0, n1, below))
        own = kt_block(zeros, ones)
        weighted = np.logaddexp(own, rest) - math.log(2)
        weight = np.exp(own - math.log(2) - weighted)
        by_node = lambda x: x.reshape(256, 256).sum(axis=0)
        root0, root1, root_rest = by_node(zeros), by_node(ones), by_node(weighted)
        root_own = kt_block(root0, root1)
        root_weight = np.exp(root_own - np.logaddexp(root_own, root_rest))
        spread = lambda x: np.tile(x, 256)
        share = spread(root_weight)
        self.passed = (1 - share) * (1 - weight)
        self.zeros = share * spread((root0 + 0.5) / (root0 + root1 + 1)) + (1 - share) * weight * (zeros + 0.5) / (zeros + ones + 1)
        self.ones = share * spread((root1 + 0.5) / (root0 + root1 + 1)) + (1 - share) * weight * (ones + 0.5) / (zeros + ones + 1)


GATHERED = "block int, part int, size int, grams binary, counts binary, word binary, n long"
SCORED = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("n_bytes", T.LongType())]


def gathered(blocks: DataFrame, depth: int) -> DataFrame:
    """Each block's distinct strings and words, with their counts in training documents."""

    def run(batches):
        words: dict[int, Counter] = {}
        grams: dict[int, Counts] = {}
        for batch in batches:
            of_block, of_train = np.asarray(batch.column(0)), np.asarray(batch.column(1).to_pylist(), dtype=bool)
            for block in np.unique(of_block).tolist():
                counter, strings = words.setdefault(block, Counter()), grams.setdefault(block, Counts())
                for train in (True, False):
                    own = batch.filter(pa.array((of_block == block) & (of_train == train)))
                    sizes = pc.binary_length(own.column(2)).to_pylist()
                    for begin, end in chunked(sizes):
                        bodies = [utf8(t).lower() for t in texts_of(own.slice(begin, end - begin), "text")]
                        for body in bodies:
                            if train:
                                counter.update(body.split())
                            else:
                                for w in set(body.split()):
                                    counter.setdefault(w, 0)
                        for own_grams in gram_stretches(bodies[0], depth) if len(bodies[0]) > CHUNK_BYTES else [grams_of(bodies, depth)[0]]:
                            unique, n = np.unique(own_grams, return_counts=True)
                            strings.add(unique, n.astype(np.int64) if train else np.zeros(len(n), np.int64))
        for block in sorted(words):
            unique, n = grams.pop(block).settle()
            part = part_of(unique)
            order = np.argsort(part, kind="stable")
            part, unique, n = part[order], unique[order], n[order]
            cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            rows = [(block, int(part[a]), b - a, packed_keys(unique[a:b]), packed(n[a:b]), None, None) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield gathered_rows(rows)
            items = list(words.pop(block).items())
            for at in range(0, len(items), 100_000):
                yield gathered_rows([(block, None, None, None, None, w, c) for w, c in items[at : at + 100_000]])

    def gathered_rows(rows):
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "part", "size", "grams", "counts", "word", "n"])

    return blocks.select("block", "train", "text").mapInArrow(run, GATHERED)


def by_part(batches):
    """Of rows (part, block, size, grams, counts) ordered by part: each part's rows without counts, its strings and their counts."""
    part, rows, counts = None, [], Counts()
    for batch in batches:
        for own, block, size, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != part and rows:
                yield rows, *counts.settle()
                rows, counts = [], Counts()
            part = own
            rows.append((block, size, keys))
            counts.add(unpacked_keys(keys, size), unpacked(n, size))
    if rows:
        yield rows, *counts.settle()


class ContextTreeModel:
    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES):
        spark = docs.sparkSession
        self.depth = depth
        self.scratch = Scratch(spark, "lm")
        source = docs.select(
            F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (crc_mod(F.col(doc_id), 7) != HELD_OUT).alias("train")
        )
        size = source.agg(F.sum(F.octet_length("text")), F.sum(F.col("train").cast("long"))).first()
        self.train_docs = size[1] or 0
        self.n_blocks = max(1, math.ceil((size[0] or 0) / block_bytes))
        self.blocks = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n_blocks)).cast("int"))
        self.parts = max(self.n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.gathered = self.scratch.keep(gathered(self.blocks.repartition(self.parts, "block"), depth), "gathered")
        self.words = self.scratch.keep(
            self.gathered.filter("word IS NOT NULL AND n > 0").groupBy("word").agg(F.sum("n").alias("c")), "words"
        )
        total = self.words.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.train_tokens = (total[0] or 0) + self.train_docs
        self.distinct = total[1] + (self.train_docs > 0)

    def _model(self) -> DataFrame:
        """PACKED: each block's strings, and log10 probability of a string's byte after its context."""
        depth = self.depth
        spark = self.gathered.sparkSession
        strings = self.gathered.filter("part IS NOT NULL").select("part", "block", "size", "grams", "counts")
        dealt = strings.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")

        def upward(batches):
            for _, keys, n in by_part(batches):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in Trees(keys, n, depth).upward()], names=["node", "n0", "n1", "below"])

        sums = dealt.mapInArrow(upward, "node long, n0 double, n1 double, below double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below")))
        rows = sums.orderBy("node").collect()  # 256 * 255 rows at most
        top = Top(*(np.array([r[c] for r in rows], dtype=t) for c, t in (("node", np.int64), ("n0", float), ("n1", float), ("below", float))))
        held_top = spark.sparkContext.broadcast(top)

        def downward(batches):
            for rows, keys, n in by_part(batches):
                logs = Trees(keys, n, depth).log10(held_top.value)
                for block, size, own in rows:
                    numbers = packed(logs[np.searchsorted(keys, unpacked_keys(own, size))])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own], pa.binary()), pa.array([numbers], pa.binary()), pa.array([size], pa.int32())], names=["block", "keys", "numbers", "of_strings"])

        return dealt.mapInArrow(downward, PACKED)

    def scored(self) -> DataFrame:
        """doc_id, train and the scores of each document."""
        id_type = self.blocks.schema["doc_id"].dataType
        words = self.gathered.filter("word IS NOT NULL").select("block", "word").join(self.words, "word").select("block", "word", "c")
        tables = self._model().unionByName(words.mapInArrow(packed_words, PACKED))
        empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("doc_id", id_type), ("text", "string"), ("train", "boolean"))}
        documents = self.blocks.select("block", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("numbers"), F.lit(None).cast("int").alias("of_strings"), "doc_id", "text", "train")
        rows = tables.select("block", "keys", "numbers", "of_strings", *empty.values()).unionByName(documents)
        # a block's strings and words come before its documents
        dealt = rows.repartition(self.parts, "block").sortWithinPartitions("block", F.col("text").isNotNull())
        depth, train_tokens, train_docs = self.depth, self.train_tokens, self.train_docs
        whole = train_tokens + self.distinct + 1
        schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("train", T.BooleanType()), *(T.StructField(n, t) for n, t in SCORED)])

        def run(batches):
            block, strings, counts, ready = None, [], {}, None
            end = math.log10((train_docs + 1) / whole)
            for batch in batches:
                of_block, sizes = np.asarray(batch.column(0)), pc.fill_null(pc.binary_length(batch.column(5)), 0).to_pylist()
                is_text = np.asarray(batch.column(5).is_valid())
                at = 0
                while at < batch.num_rows:
                    if of_block[at] != block:
                        block, strings, counts, ready = of_block[at], [], {}, None
                    if not is_text[at]:
                        keys, numbers, size = (batch.column(c)[at].as_py() for c in (1, 2, 3))
                        if size is None:
                            counts.update(zip(keys.split(b" "), np.frombuffer(numbers, dtype=np.float64).tolist(), strict=True))
                        else:
                            strings.append((unpacked_keys(keys, size), unpacked(numbers, size, np.float64)))
                        at += 1
                        continue
                    if ready is None:
                        grams, logs = (np.concatenate(x) for x in zip(*strings, strict=True))
                        order = np.argsort(grams)
                        strings, ready = [], (grams[order], logs[order])
                    begin, held = at, 0
                    while at < batch.num_rows and of_block[at] == block and (at == begin or held + sizes[at] <= CHUNK_BYTES):
                        held += sizes[at]
                        at += 1
                    yield of_documents(batch.slice(begin, at - begin), ready, counts, end)

        def of_documents(own, ready, counts, end):
            bodies = [utf8(t).lower() for t in own.column(5).to_pylist()]
            n_tokens, n_known, base = [], [], []
            for body in bodies:
                words = body.split()
                c = np.fromiter(map(counts.get, words, [0.0] * len(words)), np.float64, len(words))
                n_tokens.append(len(words) + 1)
                n_known.append(int((c > 0).sum()) + (train_docs > 0))
                base.append(float(np.log10((c + 1) / whole).sum()) + end)
            if len(bodies[0]) > CHUNK_BYTES:  # then it is alone
                sizes = np.array([len(bodies[0]) + 1], dtype=np.int64)
                score = np.array([sum(float(ready[1][np.searchsorted(ready[0], g)].sum()) for g in gram_stretches(bodies[0], depth))])
            else:
                grams, sizes = grams_of(bodies, depth)
                unique, slot = np.unique(grams, return_inverse=True)
                score = np.add.reduceat(ready[1][np.searchsorted(ready[0], unique)][slot], np.cumsum(sizes) - sizes)
            return pa.RecordBatch.from_arrays(
                [own.column(4), own.column(6), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([train_tokens] * len(bodies), pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array(sizes - 1)],
                names=schema.names,
            )

        return dealt.mapInArrow(run, schema)


#: ``of_strings``: how many strings the row has; null in a row of words.
PACKED = "block int, keys binary, numbers binary, of_strings int"


def packed_words(batches, most: int = 1 << 20):
    """Rows (block, word, count) as one row for each block and ``most`` rows: words and counts back to back."""

    def flush(held):
        table = pa.Table.from_batches(held)
        order = np.argsort(np.asarray(table.column(0)), kind="stable")
        block, word, number = table.take(pa.array(order)).combine_chunks().columns
        block = np.asarray(block)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        rows = [(int(block[a]), b" ".join(word.slice(a, b - a).to_pylist()), np.asarray(number.slice(a, b - a)).astype(np.float64).tobytes(), None) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["block", "keys", "numbers", "of_strings"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= most:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def op2_context_tree(spark, sf_dir):
    small_batches(spark)
    scored = ContextTreeModel(table(spark, sf_dir, "documents")).scored()
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte")
    )
