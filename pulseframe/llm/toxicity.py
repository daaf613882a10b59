"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Method. A word's vector is the mean of the embeddings of its hashed character
n-grams (with word ends marked) and of the word itself; a passage's vector is the
mean over its words; a linear softmax over that gives the class. Embeddings and
softmax learn together by Adagrad. A label belongs to a whole document while the
offence may be one sentence, so a document is cut into passages of PASSAGE words
and, after a first epoch over all passages (in about an eighth as many batches as
documents), its most toxic passage carries the gradient; its score is that passage's. A misspelling shares most n-grams with the
word it distorts and so most of its vector, whether or not it was seen in training.

The softmax over two classes is linear in the passage's mean, so each word adds one
number to a passage's logit: tasks keep a bounded table of words' numbers.

Bounds. At most SAMPLE labelled rows with SAMPLE_BYTES of text in all are fitted, those of the
smallest hash of doc_id (``common.sample_texts``); the model has BUCKETS x DIM numbers whatever the input, and is broadcast.

Semantics. A text without words (or null) gets the training rows' share of label 1.
Only text enters a score. Rows without label, with a null label or null doc_id never train.
Repeated rows are scored each by itself, but of one doc_id the least text alone trains; labels of a
document that differ all train, equal ones once.
With no labelled rows every score is 0 and nothing is rejected.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_BYTES, Scratch, crc_mod, free_name, pieces, sample_texts, table, texts_of, utf8

SAMPLE = 8000
BUCKETS = 1 << 17
DIM = 8
SHORTEST, LONGEST = 3, 5
PASSAGE = 4
EPOCHS = 15
RATE = 0.5
#: Starting sum of squared gradients of an embedding: a bucket that is seen once hardly moves.
DAMPING = 1e-4
MEMORY = 400_000
#: ASCII bytes that are no letter or digit separate words; capitals are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return utf8(text).translate(FOLD).split()


def subwords(word: bytes) -> list[int]:
    """Buckets of a word and its character n-grams; a word over 64 bytes is taken by its n-grams alone."""
    marked = b"<" + word + b">"
    grams = {marked} if len(marked) <= 64 else set()
    chars = marked.decode("utf-8", "replace")
    for n in range(SHORTEST, LONGEST + 1):
        grams.update(utf8(chars[i : i + n]) for i in range(len(chars) - n + 1))
    return [zlib.crc32(g) % BUCKETS for g in grams]


class SubwordSoftmax:
    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embeddings = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.softmax = draw.normal(0, 1 / math.sqrt(DIM), (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, dtype=np.float32)
        self.base = 0.0
        self.offset = math.inf

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> SubwordSoftmax:
        number: dict[bytes, int] = {}
        words, flat, sizes = array("i"), array("i"), array("i")
        begins, owner, kept = array("q"), array("i"), []
        for text, label in zip(texts, labels, strict=True):
            at = len(words)
            for word in words_of(text):
                if (known := number.get(word)) is None:
                    known = number[word] = len(number)
                    buckets = subwords(word)
                    flat.extend(buckets)
                    sizes.append(len(buckets))
                words.append(known)
            if len(words) > at:
                begins.extend(range(at, len(words), PASSAGE))
                owner.extend([len(kept)] * (len(begins) - len(owner)))
                kept.append(label)
        del number
        labels, n_docs = np.array(kept, dtype=np.int64), len(kept)
        if not n_docs:
            return self
        self.base = float(labels.mean())
        words, flat, sizes, owner, begins = (np.asarray(x) for x in (words, flat, sizes, owner, begins))
        flat_at = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.append(begins[1:], len(words))
        first_of_doc = np.searchsorted(owner, np.arange(n_docs))
        draw = np.random.default_rng(seed)
        seen = np.full(self.embeddings.shape, DAMPING, dtype=np.float32), np.full(self.softmax.shape, 1e-6, dtype=np.float32), np.full(2, 1e-6, dtype=np.float32)
        weight_of = np.where(labels == 1, 0.5 / max(self.base, 1e-6), 0.5 / max(1 - self.base, 1e-6))
        for epoch in range(epochs):
            size = 64
            if epoch == 0:
                chosen = draw.permutation(len(begins))
                size = max(size, len(chosen) // (n_docs // 8 + 1))
            else:
                logit = self.logits(flat, flat_at, sizes, words, begins, ends)
                order = np.lexsort((-logit, owner))
                chosen = draw.permutation(order[first_of_doc])
            for batch in np.array_split(chosen, max(1, len(chosen) // size)):
                own = [words[begins[p] : ends[p]] for p in batch]
                lengths = np.array([len(o) for o in own])
                every = np.concatenate(own)
                spread = sizes[every]
                inside = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
                ids = flat[np.repeat(flat_at[every], spread) + inside]
                row = np.repeat(np.repeat(np.arange(len(batch)), lengths), spread)
                share = (1 / np.repeat(spread, spread) / lengths[row]).astype(np.float32)
                hidden = np.zeros((len(batch), DIM), dtype=np.float32)
                vectors = self.embeddings[ids] * share[:, None]
                hidden = np.add.reduceat(vectors, np.searchsorted(row, np.arange(len(batch))))
                z = hidden @ self.softmax + self.bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                error = z / z.sum(axis=1, keepdims=True)
                error[np.arange(len(batch)), labels[owner[batch]]] -= 1
                error *= (weight_of[owner[batch]] / len(batch))[:, None]
                error = error.astype(np.float32)
                back = error @ self.softmax.T
                touched, slot = np.unique(ids, return_inverse=True)
                scaled = back[row] * share[:, None]
                step = np.stack([np.bincount(slot, scaled[:, k], len(touched)) for k in range(DIM)], axis=1).astype(np.float32)
                for store, sums, at_, g in ((self.softmax, seen[1], ..., hidden.T @ error), (self.bias, seen[2], ..., error.sum(axis=0)), (self.embeddings, seen[0], touched, step)):
                    sums[at_] += g * g
                    store[at_] -= rate * g / np.sqrt(sums[at_])
        logit = self.logits(flat, flat_at, sizes, words, begins, ends)
        self.offset = best_cut(np.maximum.reduceat(logit, first_of_doc), labels)
        return self

    def logits(self, flat, flat_at, sizes, words, begins, ends) -> np.ndarray:
        """Of each passage: words are numbered, and their buckets lie in ``flat`` from ``flat_at`` on."""
        numbers = np.add.reduceat((self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0]))[flat], flat_at[:-1]) / sizes
        return np.add.reduceat(numbers[words], begins) / (ends - begins)

    def scorer(self):
        numbers = (self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float64)
        known: dict[bytes, float] = {}
        base, offset = self.base, self.offset

        def score(text: str) -> float:
            words = words_of(text)
            if not words:
                return min(base, 0.499999)
            if len(known) > MEMORY:
                known.clear()
            values = list(map(known.get, words))
            if None in values:
                for i, (w, v) in enumerate(zip(words, values, strict=True)):
                    if v is None:
                        v = known.get(w)
                        if v is None:
                            v = known[w] = float(numbers[subwords(w)].mean())
                        values[i] = v
            logit = float(passage_logits(np.array(values)).max()) - offset
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))

        return score


def passage_logits(numbers: np.ndarray) -> np.ndarray:
    begins = np.arange(0, len(numbers), PASSAGE)
    return np.add.reduceat(numbers, begins) / (np.append(begins[1:], len(numbers)) - begins)


def best_cut(logit: np.ndarray, labels: np.ndarray) -> float:
    """The logit that separates the classes with the fewest errors, halfway between its neighbours."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], labels[order]
    below = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum() - np.concatenate([[0], np.cumsum(1 - y)]))
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    best = np.flatnonzero(below == below.min())
    return float(edges[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> SubwordSoftmax:
    """Learns labels.toxic from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    train = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    train = train.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    picked = train.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    source = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = sorted((r.doc_id, r.toxic, r.body) for r in sample_texts(source, picked, Scratch(docs.sparkSession, "toxicity"), most))
    return SubwordSoftmax().fit([b for _, _, b in rows], [y for _, y, _ in rows])


def annotate(docs: DataFrame, model: SubwordSoftmax, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the toxicity of the texts, and that column's name."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    name = free_name(docs.columns, "toxicity")

    def run(batches):
        score = held.value.scorer()
        for batch in pieces(batches, text):
            scores = pa.array([score(t) for t in texts_of(batch, text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` less those that the model calls toxic."""
    columns = docs.columns
    scored, name = annotate(docs, fit(docs, labels))
    return scored.filter(F.col(name) < 0.5).select(*columns)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, name = annotate(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col(name).alias("score"), (F.col(name) >= 0.5).cast("int").alias("predicted")
    )
