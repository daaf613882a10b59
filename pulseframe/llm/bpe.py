"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Method. The pattern splits a text into pieces; a piece that is itself a token is
looked up. For any other piece a segment tree over its byte positions holds, at
each live position, the rank of joining that symbol with its live right neighbour;
the root gives the smallest rank, the descent its leftmost position. A merge
rewrites three leaves (the merged symbol, the one before it, the one swallowed),
so a piece of n bytes takes O(n log n). Each task keeps a bounded table of pieces
it has encoded.

Semantics. A null text is empty and has no tokens. Nothing is shuffled; repeated
rows are encoded each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, pieces, table, texts_of, utf8

#: Pieces that a task remembers before it starts anew (some 300 bytes each).
MEMORY = 800_000
NEVER = 1 << 62
#: White space as the tokenizer's own pattern engine has it, without the separators U+001C to U+001F.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def with_plain_space(pattern: str) -> str:
    """The pattern with its white-space classes spelt out."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.split = regex.compile(with_plain_space(pattern)).findall
        self.tokens = {i: b for b, i in ranks.items()}
        self.names = {i: b"%d " % i for i in self.tokens}
        self.known: dict[str, tuple[int, bytes, bytes]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, longest = len(piece), self.longest
        size = 1 << max(1, (n - 1).bit_length())
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get(piece[i : i + 2], NEVER)
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = ranks.get
        while (least := tree[1]) != NEVER:
            at = 1
            while at < size:
                at *= 2
                if tree[at] != least:
                    at += 1
            here = at - size
            gone = after[here]
            beyond = after[gone]
            left = before[here]
            after[here] = beyond
            tree[size + gone] = tree[at] = NEVER
            if beyond < n:
                before[beyond] = here
                end = after[beyond]
                if end - here <= longest:
                    tree[at] = get(piece[here:end], NEVER)
            if left < 0:
                left = here
            else:
                tree[size + left] = get(piece[left:beyond], NEVER) if beyond - left <= longest else NEVER
            # the three leaves' parents, level by level; they soon coincide
            a, b, c = size + left, at, size + gone
            while a > 1:
                a >>= 1
                b >>= 1
                c >>= 1
                x, y = tree[2 * a], tree[2 * a + 1]
                tree[a] = x if x <= y else y
                if b != a:
                    x, y = tree[2 * b], tree[2 * b + 1]
                    tree[b] = x if x <= y else y
                if c != b:
                    x, y = tree[2 * c], tree[2 * c + 1]
                    tree[c] = x if x <= y else y
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(utf8(piece))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def learn(self, piece: str) -> tuple[int, bytes, bytes]:
        """Number of ids, their decimals each followed by a space, and the bytes that they decode to."""
        if len(self.known) >= MEMORY:
            self.known.clear()
        ids = self.encode_piece(utf8(piece))
        entry = (len(ids), b"".join(map(self.names.__getitem__, ids)), self.decode(ids))
        if len(piece) <= 64:
            self.known[piece] = entry
        return entry

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by spaces, SHA-256 of the decoded bytes."""
        known, learn = self.known.get, self.learn
        entries = [known(piece) or learn(piece) for piece in self.split(text)]
        names = b"".join([e[1] for e in entries])[:-1]
        decoded = b"".join([e[2] for e in entries])
        return sum([e[0] for e in entries]), hashlib.sha256(names).hexdigest(), hashlib.sha256(decoded).hexdigest()


_codecs: dict[tuple, Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """One for each Python worker: building it takes longer than a small task."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def vocabulary(vocab_path: str | None, pattern: str | None) -> tuple[dict[bytes, int], str]:
    if vocab_path is None or pattern is None:
        import public_tokenizers

        vocab_path = vocab_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    with open(vocab_path, "rb") as file:
        return read_ranks(file.read()), pattern


def encode(docs: DataFrame, text: str = "text", vocab_path: str | None = None, pattern: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with the texts' ids (array<int>), and that column's name. The vocabulary's size bounds what is broadcast."""
    ranks, pattern = vocabulary(vocab_path, pattern)
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    name = free_name(docs.columns, "ids")

    def run(batches):
        own = codec(held.value, pattern)
        for batch in pieces(batches, text):
            ids = pa.array([own.encode(t) for t in texts_of(batch, text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])), name


def decode(encoded: DataFrame, ids: str = "ids", vocab_path: str | None = None, pattern: str | None = None) -> tuple[DataFrame, str]:
    """``encoded`` with the bytes that the ids stand for, and that column's name."""
    ranks, pattern = vocabulary(vocab_path, pattern)
    held = encoded.sparkSession.sparkContext.broadcast(ranks)
    name = free_name(encoded.columns, "decoded")

    def run(batches):
        own = codec(held.value, pattern)
        for batch in batches:
            got = pa.array([own.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())])), name


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocab_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every whole text."""
    ranks, pattern = vocabulary(vocab_path, pattern)
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = [source.schema["doc_id"], *(T.StructField(c, t) for c, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))]

    def run(batches):
        own = codec(held.value, pattern)
        for batch in pieces(batches, "text"):
            n, ids, back = zip(*map(own.digest, texts_of(batch, "text")), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        own.known.clear()  # else it would stay in the worker's memory, beside later stages

    return source.mapInArrow(run, T.StructType(fields))


def op7_byte_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))
