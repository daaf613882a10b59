"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method. Best-fit decreasing over the whole corpus: pieces go, longest first, each to the
tightest open sequence that holds it, which a segment tree over remaining capacities finds
in logarithmic time. Pieces of one length are interchangeable and so are sequences of one
remaining capacity, so the tree's leaves hold ranges of sequences and one descent places a
whole run of equal pieces just as one descent for each of them would. The plan therefore
comes from the histogram of lengths (at most ``limit`` numbers) however many documents
there are, and is the plan for all of them at once, not one for each partition.

Spark tokenises, counts lengths, numbers the pieces by one sort by length (see
``common.positions``) and looks each number up in the plan's runs. A plan has a run for
each length and range of sequences it uses; ranges split only where a length ends, so there
are at most 3 * limit of them and 3 * limit**2 runs (in practice a few thousand).

Tokens. Texts are cut where the tokenizer's own pattern always cuts, at a single space
between two characters that aren't white space; each distinct unit is encoded once a worker by
the tokenizers library, whose byte-level BPE model makes every id, and remembered. Ids of a
text are those of its units in a row. Only a unit, a stretch without such a space, is ever
encoded whole.

Semantics. A null text is empty and has the end id alone. Texts with the string of a special
token hold it as ordinary text. Rows that repeat are packed each by itself. An empty table
gives an empty result. Rows of ``pack`` whose length is null or not in 1 to ``limit`` get no
sequence. Columns that clash with new ones get those with underscores before them.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, pieces, positions, table

LIMIT = 1024
END = 2
#: Units that a worker remembers before it starts anew (some 200 bytes each), and the longest of them.
MEMORY = 800_000
LONGEST = 64
#: Characters of a text that are in units at a time.
CHUNK = 1 << 20
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
#: A word and its marks, or two of them on two lines: each is a piece of the pattern, and so is the line end.
PLAIN = re.compile(f"({LATIN})([.,;:!?]*)(?:(\n)({LATIN})([.,;:!?]*))?")


def byte_letters() -> str:
    """The letter that byte-level vocabularies write each byte as: printable Latin-1 ones as themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


class Remembered(dict):
    """Ids of units, made when first asked for; None for what ``make`` doesn't take."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, unit: str) -> bytes | None:
        ids = self.make(unit)
        if len(unit) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[unit] = ids
        return ids


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    In units as PLAIN has them the pattern's pieces are plain to see; these go to the library's
    merges at once. Any other unit goes through the whole library.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.merge = self.tokenizer.model.tokenize
        self.numbers = [np.array(i, dtype="<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.space = self.letters[32]
        self.opening = Remembered(self.opens, MEMORY // 8)
        self.spaced = Remembered(self.follows, MEMORY)

    def piece(self, text: str, before: str = "") -> bytes:
        """Ids of one piece of the pattern; ``before`` is spelt already."""
        spelt = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.numbers[t.id] for t in self.merge(before + spelt)])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def opens(self, unit: str) -> bytes:
        """A unit at the beginning of a text or line."""
        if (plain := PLAIN.fullmatch(unit)) is None:
            return self.whole(unit)
        word, marks, line, second, more = plain.groups()
        ids = self.piece(word) + (self.piece(marks) if marks else b"")
        return ids + self.piece("\n") + self.opening[second] + (self.opening[more] if more else b"") if line else ids

    def follows(self, unit: str) -> bytes | None:
        """A unit after a single space; None if it begins or ends with white space or is empty."""
        if unit.isascii() and unit.isalpha():
            return b"".join([self.numbers[t.id] for t in self.merge(self.space + unit)])
        if (plain := PLAIN.fullmatch(unit)) is None:
            return self.whole(" " + unit) if unit and not unit[0].isspace() and not unit[-1].isspace() else None
        word, marks, line, second, more = plain.groups()
        if len(word) == len(unit):
            return self.piece(word, self.space)
        ids = self.spaced[word] + (self.opening[marks] if marks else b"")
        return ids + self.opening["\n"] + self.opening[second] + (self.opening[more] if more else b"") if line else ids

    def encode(self, text: str) -> bytes:
        """Ids of any text, a stretch of about CHUNK characters at a time."""
        if not text:
            return b""
        first = BETWEEN.search(text)
        if first is None:
            return self.whole(text)
        out, begin = [self.opening[text[: first.start()]]], first.end()
        while begin <= len(text):
            cut = BETWEEN.search(text, begin + CHUNK)
            end, after = (cut.start(), cut.end()) if cut else (len(text), len(text) + 1)
            units = BETWEEN.split(text[begin:end])
            out.extend(self.whole(" " + u) if ids is None else ids for u, ids in zip(units, map(self.spaced.__getitem__, units), strict=True))
            begin = after
        return b"".join(out)

    def encode_all(self, column: pa.Array) -> list[bytes]:
        """Ids of every text. Units of texts that have only single spaces, each between two words, are told apart for all of them at once."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = np.asarray(pc.binary_length(column))
        able = np.flatnonzero((sizes > 0) & (sizes <= CHUNK))
        out: list[bytes | None] = [None] * len(column)
        if len(able):
            parts = pc.split_pattern(column.take(pa.array(able)), " ")
            offsets = np.asarray(parts.offsets)
            begins, coded = offsets[:-1], parts.flatten().dictionary_encode()
            index, units = np.array(coded.indices), coded.dictionary.to_pylist()
            found = list(map(self.spaced.__getitem__, units))
            odd = np.fromiter((f is None for f in found), dtype=bool, count=len(found))
            regular = ~np.logical_or.reduceat(odd[index], begins)
            firsts = [self.opening[units[i]] if good else b"" for i, good in zip(index[begins].tolist(), regular.tolist(), strict=True)]
            index[begins] = len(units) + np.arange(len(begins))
            every, numbers, bounds = found + firsts, index.tolist(), offsets.tolist()
            for row, good, a, b in zip(able.tolist(), regular.tolist(), bounds, bounds[1:], strict=False):
                if good:
                    out[row] = b"".join([every[i] for i in numbers[a:b]])
        return [self.encode(text) if ids is None else ids for text, ids in zip(column.to_pylist(), out, strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """One for each Python worker, which keeps what it remembers from task to task."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def cuts(n: int, limit: int) -> list[int]:
    """Starts of a document's pieces: all have ``limit`` tokens but the first, which may have fewer."""
    rest = n % limit
    return ([0] if rest else []) + list(range(rest, n, limit))


def tokenise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, end: int | None = END, vocab_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (``with_ids``) ids of each piece; ``end`` follows a document's ids."""
    if vocab_path is None:
        import public_tokenizers

        vocab_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(vocab_path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(c, t) for c, t in kinds if with_ids or c != "ids")])
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches):
        encoder = encoder_of(held.value)
        for batch in pieces(batches, "text"):
            at, number, starts, parts = [], [], [], []
            for row, data in enumerate(encoder.encode_all(batch.column(1))):
                data += tail
                begins = cuts(len(data) // 4, limit)
                at.extend([row] * len(begins))
                number.extend(range(len(begins)))
                starts.extend(begins)
                parts.extend(data[4 * a : 4 * b] for a, b in zip(begins, [*begins[1:], len(data) // 4], strict=True))
            lengths = [len(p) // 4 for p in parts]
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype="<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


class Capacities:
    """Open sequences by remaining capacity: leaves hold ranges of sequences, inner nodes whether any lies below."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.open = bytearray(2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least ``need`` that an open sequence has."""
        node = self.size + need
        if self.open[node]:
            return need
        while node > 1 and (node & 1 or not self.open[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size

    def put(self, capacity: int, first: int, count: int) -> None:
        if count:
            self.ranges[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        found = self.ranges[capacity].pop()
        self._mark(capacity)
        return found

    def _mark(self, capacity: int) -> None:
        node, state = self.size + capacity, int(bool(self.ranges[capacity]))
        while node and self.open[node] != state:
            self.open[node] = state
            node >>= 1
            state = self.open[2 * node] | self.open[2 * node + 1] if node else 0


def best_fit(histogram: dict[int, int], limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing of so many pieces of each length: runs, and the number of sequences.

    A run (length, first, count, per_sequence, sequence, offset) puts pieces first .. first + count - 1
    of that length into sequences from ``sequence`` on, ``per_sequence`` in each, from ``offset`` on.
    """
    tree, runs, used = Capacities(limit), [], 0
    for length in sorted(histogram, reverse=True):
        done, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity = limit
                first, count = used, -(-left // (limit // length))
                used += count
            else:
                first, count = tree.take(capacity)
            each, offset = capacity // length, limit - capacity
            filled = min(count, left // each)
            over = 0 if filled == count else min(left - filled * each, each)
            if filled:
                runs.append((length, done, filled * each, each, first, offset))
                tree.put(capacity - each * length, first, filled)
            if over:
                runs.append((length, done + filled * each, over, each, first + filled, offset))
                tree.put(capacity - over * length, first + filled, 1)
            taken = filled + bool(over)
            tree.put(capacity, first + taken, count - taken)
            done, left = done + filled * each + over, left - filled * each - over
    return runs, used


def pack(rows: DataFrame, limit: int = LIMIT, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with sequence_id and offset (long), and the names that these got; ``order`` says which of equal lengths comes first."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "packing")
    names = {}
    for c in ("sequence_id", "offset"):
        names[c] = free_name([*rows.columns, *names.values()], c)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in names.values())])
    rows = scratch.keep(rows, "rows")
    fits = F.col(length).isNotNull() & F.col(length).between(1, limit)
    histogram = {int(r["l"]): r["n"] for r in rows.filter(fits).groupBy(F.col(length).alias("l")).agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit(histogram, limit)
    before, begin = {}, 0
    for size in sorted(histogram):
        before[size], begin = begin, begin + histogram[size]
    plan = np.array(sorted((before[size] + first, size, each, sequence, offset) for size, first, _, each, sequence, offset in runs), dtype=np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(plan)
    placed, place = positions(rows.filter(fits), [F.col(c) for c in (length, *order)], scratch, "placed")
    placed = placed.select(*rows.columns, place)

    def run(batches):
        starts, sizes, each, sequence, offset = held.value.T
        for batch in batches:
            at = np.asarray(batch.column(batch.num_columns - 1))
            own = np.searchsorted(starts, at, side="right") - 1
            nth = at - starts[own]
            columns = [sequence[own] + nth // each[own], offset[own] + nth % each[own] * sizes[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    rest = rows.filter(~fits | F.col(length).isNull()).select(*rows.columns, *(F.lit(None).cast("long").alias(n) for n in names.values()))
    return placed.mapInArrow(run, schema).unionByName(rest), names


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids of each sequence of tokenised and packed pieces; no group has more than ``limit`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = packed.filter("sequence_id IS NOT NULL").groupBy("sequence_id").agg(parts.alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op13_packing(spark, sf_dir):
    packed, _ = pack(tokenise(table(spark, sf_dir, "documents"), with_ids=False))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
