"""Repeated passages by a distributed merge sort of suffixes.

What is removed: each byte covered by a SPAN-byte string that also starts anywhere else.

Which suffixes. Every SPAN-byte window of a text names one anchor: the leftmost of its
GRAM-byte strings with the smallest hash. Equal windows have equal anchors at equal
distances, so windows need only be compared below equal anchor grams; consecutive
windows share an anchor, about one for every (SPAN - GRAM) / 2 bytes. An anchor's
context is all its windows together. Contexts that occur twice as a whole (copies,
inner parts of copied passages) are settled by counting; what goes into the sort is
one suffix for each distinct context below a gram that has several: the edges of
repeated passages.

The sort. Each task sorts its suffixes (gram hash, then the bytes from the anchor on)
and front-codes them: a suffix is sent as the length of the prefix it shares with the
one before it, and the rest. Gram hashes deal the runs to owner tasks, where an LCP
loser tree merges them: players are compared by the prefix they share with the last
winner, and bytes only from there on, so no known prefix is compared again. The merge
yields the order and the LCP array below each gram; with the bytes left of the anchor
that decides, for each distance, which windows meet an equal one.

Two alphabets. Over bytes, SPAN-byte strings that start anywhere else, the same document
included, are removed. Over words (each its 64-bit hash, so strings of words are byte
strings too, read in steps of eight), the same search tells which passages of PASSAGE
words or more another document holds; that is only reported, since a passage of so many
short words may have fewer than SPAN bytes.

Grams with over HOT distinct contexts (boilerplate in ever new surroundings) are
split further by the bytes that all windows of a block of distances share, so one
gram doesn't land in one task.

Semantics. A null text is empty; matches never cross documents; strings are judged on
the input. A row is named by its doc_id and text, so rows that repeat both are copies
of each other and get the same result; null doc_ids are allowed. Texts under SPAN
bytes stay whole. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_apart, marked_apart, pieces, table, texts_of, utf8, with_small_side

SPAN = 400
GRAM = 64
#: Words of a passage that is reported if another document has it too.
PASSAGE = 51
#: Distinct contexts of a gram beyond which it is split, and the distances in a block.
HOT = 2000
BLOCK = 25
#: Window starts that are looked at together; texts beyond that go piece by piece.
PIECE = 4 << 20
#: Suffixes that one merge task takes, about.
MERGE_ROWS = 40_000

_BYTES = np.array([xxhash.xxh3_64_intdigest(b"byte %d" % i) for i in range(256)], dtype=np.uint64)
_STEPS = [np.uint64(xxhash.xxh3_64_intdigest(b"step %d" % i) | 1) for i in range(16)]
_POSITION = np.uint64((1 << 24) - 1)


class Alphabet(NamedTuple):
    """What strings are made of: ``width`` bytes a symbol, in windows of ``span`` and grams of ``gram`` symbols."""

    width: int
    span: int
    gram: int
    #: Whether a window must occur in another document, not just elsewhere.
    across: bool

    def data(self, text: str) -> bytes:
        raw = utf8(text)
        if self.width == 1:
            return raw
        words = raw.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)).tobytes()

    def codes(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=np.uint8 if self.width == 1 else np.uint64)


def of_bytes() -> Alphabet:
    return Alphabet(1, SPAN, GRAM, False)


def of_words(passage: int = PASSAGE) -> Alphabet:
    return Alphabet(8, passage, 8, True)


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` (a power of two) consecutive symbols: bytes, or words by their hashes."""
    h, width, step = _BYTES[codes] if codes.dtype == np.uint8 else codes, 1, 0
    while width < gram:
        h = h[:-width] * _STEPS[step] + h[width:]
        width, step = 2 * width, step + 1
    h ^= h >> np.uint64(32)
    h *= _STEPS[15]
    h ^= h >> np.uint64(29)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    n = len(x) - width + 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n]) if done < width else x[:n]


def anchors_of(codes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window start and last window start of each run of windows with one anchor."""
    found = []
    for base in range(0, len(codes) - span + 1, PIECE):
        piece = codes[base : base + PIECE + span - 1]
        key = gram_hashes(piece, gram)
        key &= ~_POSITION
        key |= np.arange(len(key), dtype=np.uint64)
        at = (sliding_least(key, span - gram + 1) & _POSITION).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.append(first[1:] - 1, len(at) - 1)
        found.append((at[first] + base, first + base, last + base))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


ROW_KEY = ("id", "body_hash")
ANCHOR = "id long, body_hash long, anchor int, first int, last int, gram long, context long"


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(body).alias("body_hash"),
        body.alias("text"),
    )


def anchored(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """All anchors of all texts, with the hashes of gram and context."""
    names = [c.split()[0] for c in ANCHOR.split(", ")]
    width, span, size, _ = alphabet

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in pieces(batches, "text"):
            ids, hashes = (np.asarray(batch.column(i)) for i in (0, 1))
            out = []
            for row, text in enumerate(texts_of(batch, "text")):
                data = alphabet.data(text)
                if len(data) < span * width:
                    continue
                at, first, last = anchors_of(alphabet.codes(data), span, size)
                a, f, z = at.tolist(), first.tolist(), last.tolist()
                gram = np.array([digest(data[p * width : (p + size) * width]) for p in a], dtype=np.uint64).view(np.int64)
                # the seed holds where in the context the anchor and the last window are
                context = np.array([digest(data[lo * width : (hi + span) * width], (p - lo) << 32 | (hi - lo)) for p, lo, hi in zip(a, f, z, strict=True)], dtype=np.uint64).view(np.int64)
                n = len(a)
                out.append((np.full(n, ids[row]), np.full(n, hashes[row]), at.astype(np.int32), first.astype(np.int32), last.astype(np.int32), gram, context))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return rows.select(*ROW_KEY, "text").mapInArrow(run, ANCHOR)


SUFFIX = "owner int, run long, seq long, shared int, rest binary, left binary, least int, most int, lone boolean, id long, body_hash long, anchor int"
SUFFIX_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
SUFFIX_NAMES = [c.split()[0] for c in SUFFIX.split(", ")]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = 32
    while a[known : known + step] == b[known : known + step]:
        known += step
    while a[known] == b[known]:
        known += 1
    return known


def suffixes(alphabet: Alphabet, data: bytes, anchor: int, first: int, last: int, gram: int, hot: bool):
    """(key and bytes from the anchor on, bytes before it, least and most distance) of one context."""
    least, most = anchor - last, anchor - first
    key = (gram & (2**64 - 1)).to_bytes(8, "big")
    width, span = alphabet.width, alphabet.span
    cut = lambda begin, end: data[begin * width : end * width]
    if not hot:
        yield key + cut(anchor, last + span), cut(first, anchor), least, most
        return
    step = min(BLOCK, span // 4)
    for block in range(least // step, most // step + 1):
        core = cut(anchor - block * step, anchor - (block + 1) * step + 1 + span)
        own = xxhash.xxh3_64_digest(key + block.to_bytes(4, "big") + core)
        lo, hi = max(least, block * step), min(most, block * step + step - 1)
        yield own + cut(anchor, anchor - lo + span), cut(anchor - hi, anchor), lo, hi


def front_coded(needed: DataFrame, owners: int, alphabet: Alphabet) -> DataFrame:
    """Sorted runs of the suffixes of (id, body_hash, text, wanted: contexts), front-coded for each owner."""
    most = 20_000

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held = []

        def sorted_run():
            nonlocal number
            held.sort(key=lambda x: (x[0], x[1]))
            out, before, owner_before = [], b"", -1
            for seq, (owner, key, *rest) in enumerate(held):
                shared = common_prefix(before, key) if owner == owner_before else 0
                out.append((owner, number, seq, shared, key[shared:], *rest))
                before, owner_before = key, owner
            number += 1
            held.clear()
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, SUFFIX_ARROW, strict=True)], names=SUFFIX_NAMES)

        for batch in pieces(batches, "text"):
            fields = batch.to_pydict()
            for id_, body, text, wanted in zip(*(fields[c] for c in (*ROW_KEY, "text", "wanted")), strict=True):
                data = alphabet.data(text)
                for w in wanted:
                    for key, left, least, far in suffixes(alphabet, data, w["anchor"], w["first"], w["last"], w["gram"], w["hot"]):
                        held.append((int.from_bytes(key[:8], "big") * owners >> 64, key, left, least, far, w["lone"], id_, body, w["anchor"]))
                if len(held) >= most:
                    yield sorted_run()
        if held:
            yield sorted_run()

    return needed.mapInArrow(run, SUFFIX)


class LcpLoserTree:
    """Merges front-coded sorted runs; each item comes with the prefix it shares with the one before it.

    ``runs`` yield (shared with the run's item before, rest of the string, payload).
    A player holds its string and the prefix it shares with the last winner. Of two
    players the one that shares more comes first; if both share as much, bytes are
    compared from there on, and the loser then knows what it shares with the winner.
    """

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        k = len(self.runs)
        self.text: list[bytes | None] = [b""] * k
        self.known = [0] * k
        self.load: list = [None] * k
        self.compared = 0
        self.tree = [-1] * max(1, k)
        for player in range(k):
            self._next(player)
            self._enter(player)

    def _next(self, player: int) -> None:
        item = next(self.runs[player], None)
        if item is None:
            self.text[player] = None
            return
        shared, rest, self.load[player] = item
        self.text[player] = self.text[player][:shared] + rest
        self.known[player] = shared

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.known[a] != self.known[b]:
            return (a, b) if self.known[a] > self.known[b] else (b, a)
        start = self.known[a]
        shared = common_prefix(x, y, start)
        self.compared += shared - start
        if (x[shared:], a) > (y[shared:], b):
            a, b = b, a
        self.known[b] = shared
        return a, b

    def _enter(self, player: int) -> None:
        node = (player + len(self.runs)) // 2
        while node:
            if self.tree[node] < 0:
                self.tree[node] = player
                return
            player, self.tree[node] = self._play(self.tree[node], player)
            node //= 2
        self.tree[0] = player

    def __iter__(self):
        k = len(self.runs)
        while k and self.text[won := self.tree[0]] is not None:
            yield self.known[won], self.text[won], self.load[won]
            self._next(won)
            player, node = won, (won + k) // 2
            while node:
                player, self.tree[node] = self._play(self.tree[node], player)
                node //= 2
            self.tree[0] = player


def met(span: int, shared: list[int], left: list[bytes], width: int, least: list[int], most: list[int], of: list[int]) -> list[list[tuple[int, int]]]:
    """For each suffix of one gram, ranges of distances at which its window equals another's.

    Suffixes are in order; ``shared[i]`` is what i shares with i - 1, from the anchor on.
    Only windows of unlike ``of`` count. Lengths are in symbols of ``width`` bytes.
    """
    n = len(left)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= 6:
        for i in range(n):
            right = span
            for j in range(i + 1, n):
                right = min(right, shared[j])
                lo = max(span - right, least[i], least[j])
                hi = min(most[i], most[j])
                if lo > hi or of[i] == of[j]:
                    continue
                near = common_prefix(left[i][::-1], left[j][::-1]) // width
                hi = min(hi, near)
                if lo <= hi:
                    out[i].append((lo, hi))
                    out[j].append((lo, hi))
        return out
    backward = [x[::-1] for x in left]
    order = sorted(range(n), key=backward.__getitem__)
    near = np.array([0] + [common_prefix(backward[a], backward[b]) // width for a, b in zip(order, order[1:], strict=False)])
    order, right = np.array(order), np.array(shared)
    low, high, owner = np.array(least), np.array(most), np.array(of)
    # between these distances nothing changes
    cuts = np.unique(np.concatenate([low, high + 1, span - right, near + 1]))
    cuts = cuts[(cuts >= low.min()) & (cuts <= high.max() + 1)]
    for begin, end in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        active = np.flatnonzero((low <= begin) & (high >= begin))
        if len(active) < 2:
            continue
        of_right = np.cumsum(right < span - begin)
        of_left = np.empty(n, dtype=np.int64)
        of_left[order] = np.cumsum(near < begin)
        pair = of_right[active] * (n + 1) + of_left[active]
        _, slot = np.unique(pair, return_inverse=True)
        lowest, highest = np.full(slot.max() + 1, n), np.full(slot.max() + 1, -1)
        np.minimum.at(lowest, slot, owner[active])
        np.maximum.at(highest, slot, owner[active])
        for i in active[lowest[slot] < highest[slot]].tolist():
            out[i].append((begin, end - 1))
    return out


def settled(runs: DataFrame, owners: int, alphabet: Alphabet) -> DataFrame:
    """(id, body_hash, first, last): window starts of lone contexts that meet an equal window."""

    def solve(group, out):
        if len(group) < 2:
            return
        width = alphabet.width
        shared = [0] + [(g[0] - 8) // width for g in group[1:]]
        loads = [g[1] for g in group]
        of = list(range(len(group)))
        if alphabet.across:  # contexts of one document are no others to each other; those of several are to all
            number: dict = {}
            of = [number.setdefault(load[4:6], i) if load[3] else i for i, load in enumerate(loads)]
        found = met(alphabet.span, shared, [g[0] for g in loads], width, [g[1] for g in loads], [g[2] for g in loads], of)
        for (_, (_, _, _, lone, id_, body, anchor)), ranges in zip(group, found, strict=True):
            if lone:
                out += [(id_, body, anchor - hi, anchor - lo) for lo, hi in ranges]

    def as_batch(rows):
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[*ROW_KEY, "first", "last"])

    def merge(runs_of):
        group, out = [], []
        for shared, _, load in LcpLoserTree(runs_of.values()):
            if shared < 8:
                solve(group, out)
                group = []
            group.append((shared, load))
            if len(out) >= 20_000:
                yield as_batch(out)
                out = []
        solve(group, out)
        if out:
            yield as_batch(out)

    def run(batches):
        owner, runs_of = None, {}
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(len(SUFFIX_NAMES))), strict=True):
                if r[0] != owner:
                    yield from merge(runs_of)
                    owner, runs_of = r[0], {}
                runs_of.setdefault(r[1], []).append((r[3], r[4], r[5:]))
        yield from merge(runs_of)

    dealt = runs.repartition(owners, "owner").sortWithinPartitions("owner", "run", "seq")
    return dealt.mapInArrow(run, "id long, body_hash long, first int, last int")


class RepeatedPassages:
    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", alphabet: Alphabet | None = None):
        self.alphabet = alphabet or of_bytes()
        self.scratch = Scratch(docs.sparkSession, "suffix")
        self.rows = keyed(docs, text, doc_id)
        self.spans = self.scratch.keep(self._spans(), "spans")
        self.scratch.drop("anchors", "grams", "mixed", "contexts", "wanted", "runs")

    def _spans(self) -> DataFrame:
        """(id, body_hash, first, last): ranges of window starts whose strings occur elsewhere."""
        keep, alphabet = self.scratch.keep, self.alphabet
        row = F.struct(*ROW_KEY)
        anchors = keep(anchored(self.rows, alphabet), "anchors")
        # whether there are several of what counts as others: places, or documents
        others = (F.min(row) < F.max(row)) if alphabet.across else (F.count(F.lit(1)) > 1)
        grams = keep(
            anchors.groupBy("gram")
            .agg(others.alias("repeated"), (F.min("context") < F.max("context")).alias("several"), F.count(F.lit(1)).alias("size"))
            .filter("repeated")
            .select("gram", "several", "size"),
            "grams",
        )
        repeated = join_apart(anchors, grams, ["gram"], "size")
        whole = repeated.filter("NOT several").select(*ROW_KEY, "first", "last")
        mixed = keep(repeated.filter("several").drop("several"), "mixed")
        contexts = keep(
            mixed.groupBy("gram", "context").agg(others.alias("repeated"), F.min(F.struct(*ROW_KEY, "anchor", "first", "last")).alias("one"), F.count(F.lit(1)).alias("size")), "contexts"
        )
        copied = join_apart(mixed, contexts.filter("repeated").select("gram", "context", "size"), ["gram", "context"], "size").select(*ROW_KEY, "first", "last")
        crowds = contexts.groupBy("gram").count().filter(F.col("count") > HOT)
        parts = marked_apart(contexts, crowds, ["gram"], "count", "hot").select(
            "one.id", "one.body_hash", F.struct("one.anchor", "one.first", "one.last", "gram", (~F.col("repeated")).alias("lone"), "hot").alias("w")
        )
        wanted = keep(parts.groupBy(*ROW_KEY).agg(F.collect_list("w").alias("wanted")), "wanted")
        total = contexts.count()
        owners = max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // MERGE_ROWS + 1)
        held = self._texts_of(wanted).dropDuplicates(list(ROW_KEY))
        runs = front_coded(held.join(wanted, list(ROW_KEY)).select(*ROW_KEY, "text", "wanted"), owners, alphabet)
        return whole.unionByName(copied).unionByName(settled(runs, owners, alphabet))

    def runs(self) -> DataFrame:
        """(id, body_hash, n_runs, symbols): maximal runs that repeated windows cover, and symbols in them, of rows that have any."""
        span = self.alphabet.span
        pairs = self.spans.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

        def run(batches):
            for batch in batches:
                covered = [merged(ranges, span) for ranges in batch.column(2).to_pylist()]
                sizes = [sum(b - a for a, b in spans) for spans in covered]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, covered), pa.int64()), pa.array(sizes, pa.int64())], names=[*ROW_KEY, "n_runs", "symbols"])

        return self.scratch.keep(pairs.mapInArrow(run, "id long, body_hash long, n_runs long, symbols long"), "covered")

    def _texts_of(self, named: DataFrame) -> DataFrame:
        """The rows whose key ``named`` has."""
        return with_small_side(self.rows, named.select(*ROW_KEY), list(ROW_KEY), "left_semi", named.count())

    def kept(self) -> DataFrame:
        """doc_id, the row's key, text bytes in all, removed spans (bytes, end exclusive), and the bytes that stay."""
        ranges = self.scratch.keep(self.spans.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
        rows = ranges.count()
        names = ranges.select(*ROW_KEY)
        hit = with_small_side(self.rows, names, list(ROW_KEY), "left_semi", rows).join(ranges, list(ROW_KEY))
        rest = with_small_side(self.rows, names, list(ROW_KEY), "left_anti", rows)
        whole = rest.select(
            "doc_id", *ROW_KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
            F.expr("CAST(array() AS array<struct<first:bigint,end:bigint>>)").alias("removed"), F.col("text").cast("binary").alias("kept"),
        )
        schema = T.StructType([hit.schema["doc_id"], *whole.schema.fields[1:]])
        return whole.unionByName(hit.select("doc_id", *ROW_KEY, "text", "ranges").mapInArrow(cut_out, schema))


def merged(ranges, span: int) -> list[list[int]]:
    """What windows of ``span`` that start in the ranges cover, as maximal runs."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + span)
        else:
            out.append([first, last + span])
    return out


def cut_out(batches):
    span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    for batch in pieces(batches, "text"):
        sizes, removed, kept = [], [], []
        for text, ranges in zip(texts_of(batch, "text"), batch.column(4).to_pylist(), strict=True):
            data, spans = utf8(text), merged(ranges, SPAN)
            ends = [0, *(e for _, e in spans)]
            kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(f for f, _ in spans), len(data)], strict=True)))
            sizes.append(len(data))
            removed.append([{"first": a, "end": b} for a, b in spans])
        n_removed = [a - len(b) for a, b in zip(sizes, kept, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(span)), pa.array(kept, pa.binary())],
            names=["doc_id", *ROW_KEY, "n_bytes", "n_removed", "removed", "kept"],
        )


def op10_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = RepeatedPassages(docs).kept()
    told = kept.select("doc_id", *ROW_KEY, "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    passages = RepeatedPassages(docs, alphabet=of_words()).runs().select(*ROW_KEY, F.col("n_runs").alias("n_passages"), F.col("symbols").alias("passage_words"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_passages", "passage_words")}
    return told.join(passages, list(ROW_KEY), "left").withColumns(zero).drop(*ROW_KEY)
