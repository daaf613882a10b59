"""Benchmark decontamination by an FM-index for each shard of training documents.

Method. A shard is some SHARD_BYTES of documents. Its words become numbers, and the
stretches that could hold a benchmark window (each neighbouring pair of words occurs in
some window, long enough for the shortest window) are concatenated, each closed by a
separator of its own. Over that text one FM-index is built: suffix array by prefix doubling,
Burrows-Wheeler transform, wavelet matrix for ranks. All distinct windows are
searched backwards at once, one word a step; occurrences are located by walking
back to sampled suffix positions, and their spans are merged for each document.

No document is shuffled, and there is one pass over the documents whatever the benchmark's
size: its windows lie in the shared folder, a file for each block of BLOCK_CHARS characters,
and a task reads one file at a time, once to mark a shard's stretches and once to search
its index. One block only, the usual case, is read once a task.

Semantics. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased.
A null or empty text has no words and is never contaminated; a benchmark item
without words is ignored; items of equal text are separate items; an item_id of
null is ignored. Repeated documents are judged each by itself. Empty tables give
empty results (an empty benchmark contaminates nothing). Extra columns pass
through ``annotate``; result columns that clash get leading underscores.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, pieces, table, texts_of, utf8

WINDOW = 13
#: Characters of benchmark text whose windows are searched in one pass.
BLOCK_CHARS = 2_000_000
#: Every so many text positions the suffix array keeps its value.
SAMPLE = 8
#: Bytes of documents in a shard.
SHARD_BYTES = 16 << 20
#: Words of a shard's stretches that one index covers at most (a longer stretch has one for itself).
SHARD_WORDS = 1 << 19

#: Bytes of words as they are compared; all others separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


class WaveletMatrix:
    """Ranks and access over a sequence of small integers."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = []
        symbols = np.arange(sigma, dtype=np.int64)
        start = np.zeros(sigma, dtype=np.int64)
        for shift in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = ((seq >> shift) & 1).astype(bool)
            zeros_before = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(~ones, out=zeros_before[1:])
            n_zero = int(zeros_before[-1])
            self.levels.append((shift, zeros_before, n_zero))
            before = zeros_before[start]
            start = np.where((symbols >> shift) & 1, n_zero + start - before, before)
            seq = np.concatenate([seq[~ones], seq[ones]])
        self.start = start

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbol[k] occurs before position end[k]."""
        at = end
        for shift, zeros_before, n_zero in self.levels:
            before = zeros_before[at]
            at = np.where((symbol >> shift) & 1, n_zero + at - before, before)
        return at - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for shift, zeros_before, n_zero in self.levels:
            before = zeros_before[at]
            one = zeros_before[at + 1] == before
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, n_zero + at - before, before)
        return symbol, at - self.start[symbol]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix order of a text whose zeros are separators, each smaller than all words and the next zero."""
    n = len(tokens)
    zero = tokens == 0
    key = np.where(zero, np.cumsum(zero) - 1, tokens + int(zero.sum()))
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        order = np.argsort(rank, kind="stable")
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, dtype=np.int64)
        later[: max(0, n - width)] = rank[width:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        width *= 2


class FMIndex:
    """Backward search and location in a text of words 1..sigma-1 with separators 0."""

    def __init__(self, tokens: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_array(tokens)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=sigma))])
        self.ranks = WaveletMatrix(tokens[order - 1], sigma)
        begins = np.ones(len(tokens), dtype=bool)  # a walk back must not cross a separator
        begins[1:] = tokens[:-1] == 0
        kept = begins[order] | (order % sample == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]
        self.size = len(tokens)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of the rows of ``patterns`` (words, one length)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        alive = np.arange(len(patterns))
        for step in range(patterns.shape[1] - 1, -1, -1):
            word = patterns[alive, step]
            low[alive] = self.first[word] + self.ranks.rank(word, low[alive])
            high[alive] = self.first[word] + self.ranks.rank(word, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        found = np.zeros(len(rows), dtype=np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            done = self.kept[at]
            found[todo[done]] = self.samples[self.kept_before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                symbol, rank = self.ranks.access(at)
                at = self.first[symbol] + rank
            steps += 1
        return found


class Windows:
    """Distinct windows of benchmark items, as numbers of the block's words, and the items that have each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        known: dict[bytes, int] = {}
        number = lambda w: known.setdefault(w, len(known))
        holders: dict[tuple[int, ...], set[int]] = {}
        self.items = [item for item, words in items if words]
        for at, words in enumerate(words for _, words in items if words):
            ids = [number(w) for w in words]
            for begin in range(max(1, len(ids) - window + 1)):
                holders.setdefault(tuple(ids[begin : begin + window]), set()).add(at)
        self.words = list(known)
        self.by_length = []
        for length in sorted({len(w) for w in holders}):
            own = [w for w in holders if len(w) == length]
            ends = np.cumsum([len(holders[w]) for w in own])
            self.by_length.append((np.array(own, dtype=np.int64), ends, np.concatenate([sorted(holders[w]) for w in own])))
        self.shortest = min((len(w) for w in holders), default=0)
        pairs = {(a, b) for w in holders for a, b in zip(w, w[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.singles = np.array(sorted({w[0] for w in holders if len(w) == 1}), dtype=np.int64)


class Shard:
    """Texts whose words are numbers from 1 on; 0 stands between texts."""

    def __init__(self, texts: list[str]):
        self.number: dict[bytes, int] = {}
        parts = []
        for text in texts:
            words = words_of(text)
            for word in set(words).difference(self.number):
                self.number[word] = len(self.number) + 1
            parts.append(np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words)))
        self.n_words = [len(p) for p in parts]
        self.ids = np.concatenate([x for p in parts for x in (p, [0])]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        self.starts = np.cumsum([0] + [n + 1 for n in self.n_words])[:-1]
        self.linked, self.single = np.zeros(len(self.ids), dtype=bool), np.zeros(len(self.ids), dtype=bool)
        self.shortest = 0

    def own(self, block: Windows) -> np.ndarray:
        """The shard's numbers of the block's words, 0 for words that it lacks."""
        return np.array([self.number.get(w, 0) for w in block.words], dtype=np.int64)

    def mark(self, block: Windows) -> None:
        """Marks neighbouring words, and words by themselves, that some window of the block has."""
        own = self.own(block)
        if block.shortest:
            self.shortest = min(self.shortest or block.shortest, block.shortest)
        if len(block.pairs) and len(self.ids):
            sigma, both = len(self.number) + 1, own[block.pairs]
            keys = np.unique((both[:, 0] * sigma + both[:, 1])[(both > 0).all(axis=1)])
            if len(keys):
                key = self.ids[:-1] * sigma + self.ids[1:]
                slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                self.linked[:-1] |= keys[slot] == key
        if len(block.singles):
            wanted = np.zeros(len(self.number) + 1, dtype=bool)
            wanted[own[block.singles]] = True
            wanted[0] = False
            self.single |= wanted[self.ids]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the runs of linked words that a window may lie in."""
        if not self.shortest:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        cut = np.flatnonzero(~self.linked) + 1
        begins, ends = np.concatenate([[0], cut[:-1]]), cut
        good = (ends - begins >= max(2, self.shortest)) | ((ends - begins == 1) & self.single[begins])
        return begins[good], ends[good]

    def indexes(self):
        """(FM-index, stretches' begins in the index, their begins in the shard, the index' numbers by the shard's)."""
        begins, ends = self.stretches()
        lengths = ends - begins + 1
        part = np.cumsum(lengths) // SHARD_WORDS
        for at in np.unique(part):
            mine = np.flatnonzero(part == at)
            tokens = np.concatenate([x for i in mine for x in (self.ids[begins[i] : ends[i]], [0])])
            kinds, dense = np.unique(tokens, return_inverse=True)
            renamed = np.zeros(len(self.number) + 1, dtype=np.int64)
            renamed[kinds] = np.arange(len(kinds))
            yield FMIndex(dense.astype(np.int64), len(kinds)), np.cumsum(lengths[mine]) - lengths[mine], begins[mine], renamed


def occurrences(index: FMIndex, inside: np.ndarray, begins: np.ndarray, renamed: np.ndarray, own: np.ndarray, block: Windows):
    """(places of occurrences in the shard, their ends, window of each, windows' item lists) for each length of window."""
    for patterns, ends, holders in block.by_length:
        asked = renamed[own[patterns]]
        there = np.flatnonzero((asked > 0).all(axis=1))
        low, high = index.search(asked[there])
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        counts = (high - low)[found]
        rows = np.repeat(low[found] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        where = index.locate(rows)
        part = np.searchsorted(inside, where, side="right") - 1
        place = begins[part] + where - inside[part]
        yield place, place + patterns.shape[1], np.repeat(there[found], counts), ends, holders


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of the spans, as maximal spans in order."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return list(zip(begin[new].tolist(), reach[np.append(new[1:] - 1, len(reach) - 1)].tolist(), strict=True))


def search_texts(blocks, texts: list[str]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: its words, the merged spans of hit words, and the items that occur. ``blocks()`` gives the Windows, one after the other."""
    shard = Shard(texts)
    for block in blocks():
        shard.mark(block)
    spans, items = [[] for _ in texts], [set() for _ in texts]
    for index, inside, begins, renamed in shard.indexes():
        for block in blocks():
            for place, end, window, ends, holders in occurrences(index, inside, begins, renamed, shard.own(block), block):
                doc = np.searchsorted(shard.starts, place, side="right") - 1
                order = np.argsort(doc, kind="stable")
                cuts = np.flatnonzero(np.diff(doc[order])) + 1
                for own in np.split(order, cuts):
                    at = int(doc[own[0]])
                    spans[at] = merged(*(np.concatenate([[s[k] for s in spans[at]], x[own] - shard.starts[at]]).astype(np.int64) for k, x in enumerate((place, end))))
                    for w in np.unique(window[own]).tolist():
                        items[at].update(block.items[i] for i in holders[ends[w - 1] if w else 0 : ends[w]].tolist())
    return shard.n_words, spans, items


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The benchmark's (item_id as text, text), a block at a time; each block is collected by itself."""
    named = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("body"))
    named = named.filter(F.col("item").isNotNull())
    chars = named.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    for block in range(blocks):
        own = named if blocks == 1 else named.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        yield [(r.item, words_of(r.body)) for r in own.collect()]


def written_blocks(benchmark: DataFrame, scratch: Scratch, window: int = WINDOW) -> list[str]:
    """Files in the shared folder, one for each block's Windows."""
    paths = []
    for at, block in enumerate(item_blocks(benchmark)):
        paths.append(scratch.path(f"block-{at}"))
        system, name = fs.FileSystem.from_uri(paths[-1] if "://" in paths[-1] else f"file://{paths[-1]}")
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as file:
            file.write(pickle.dumps(Windows(block, window)))
    return paths


def read_block(path: str) -> Windows:
    system, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with system.open_input_stream(name) as file:
        return pickle.loads(file.read())


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n_words, hit_spans (words, end exclusive) and hit_items, and the names that these got."""
    names = {c: free_name(docs.columns, c) for c in ("n_words", "hit_spans", "hit_items")}
    paths = written_blocks(benchmark, Scratch(docs.sparkSession, "benchmark"), window)
    kinds = {"n_words": T.LongType(), "hit_spans": SPANS, "hit_items": T.ArrayType(T.StringType())}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[c], t) for c, t in kinds.items())])

    def run(batches):
        held = [read_block(paths[0])] if len(paths) == 1 else []
        blocks = (lambda: held) if held else (lambda: map(read_block, paths))
        for batch in pieces(batches, text, SHARD_BYTES):
            n_words, spans, items = search_texts(blocks, texts_of(batch, text))
            told = [pa.array(n_words, pa.int64()), pa.array([[{"first_word": a, "end_word": b} for a, b in s] for s in spans], ARROW_SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, schema), names


def n_hit(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s.end_word - s.first_word)


def contaminated(n_words, hit):
    return (hit > 0) & (20 * hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the contaminated ones."""
    columns = docs.columns
    found, names = annotate(docs, benchmark)
    return found.filter(~contaminated(F.col(names["n_words"]), n_hit(F.col(names["hit_spans"])))).select(*columns)


def op5_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = annotate(docs, table(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("hit_spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), hit).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS s
             FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM b WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT n FROM win),
     pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
     cand AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM pos, lens WHERE p + n - 1 <= len(w)),
     occ AS (SELECT doc_id, p, cand.n, item FROM cand JOIN win ON cand.n = win.n AND cand.s = win.s),
     hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
