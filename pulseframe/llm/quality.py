"""Quality classifier from weak labels.

Method. Overlapping heuristic labellers vote good, bad or nothing on each document.
How often each is right is not assumed: expectation-maximisation over the vote
patterns of all documents finds, for each labeller and class, the chances of its
three votes, and the share of good documents. The posterior of a document's pattern
is its soft label, and soft labels train a hashed linear scorer over words, word
shapes and repetition, which then scores every text, also where labellers say little.

Bounds. There are 3 ** labellers vote patterns at most, which the driver gets with
their counts over all documents. The scorer is fitted on at most SAMPLE documents with
SAMPLE_BYTES of text in all, those of the smallest hash of doc_id (``common.sample_texts``); it
has BUCKETS weights and is broadcast.

Semantics. A null text is empty; no labeller votes on a text without words, and its
score is the share of good documents. Repeated rows count each, but of one doc_id the least text alone
trains the scorer. An empty table gives
an empty result; if all patterns are alike the model can't tell classes apart and
every document keeps the prior. Extra columns pass through ``annotate``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_BYTES, Scratch, free_name, pieces, sample_texts, table, texts_of, utf8

SAMPLE = 20_000
BUCKETS = 1 << 18
ROUNDS = 200
EPOCHS = 5
RATE = 0.3
MEMORY = 400_000
#: Share of documents taken as good before the first round, which says what the classes mean.
PRIOR_GOOD = 0.8

_KEEP = lambda wanted: bytes(b for b in range(256) if b not in wanted)
_NOT_UPPER = _KEEP(range(65, 91))
_NOT_SYMBOL = _KEEP(b"#$%&*|{}<>[]\\^~=_@")
_NOT_PUNCTUATION = _KEEP(b".,;:!?")
_NOT_DIGIT = _KEEP(range(48, 58))
#: Frequent words of English, French, German and Spanish.
COMMON = frozenset(
    b"the of and to in is that for it with as on be at by this are was or an "
    b"le la les de des du et en un une que qui pour dans sur par au il elle est "
    b"der die das und ist den von zu mit sich ein eine nicht auch auf "
    b"el los las del se una por con para no su al lo como".split()
)


def vote(bad: bool, good: bool) -> int:
    return 0 if bad else 2 if good else 1


def votes_of(text: str) -> list[int]:
    """0 bad, 1 nothing, 2 good, from each labeller."""
    data = utf8(text)
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [1] * len(LABELLERS)
    lines = [x for x in data.split(b"\n") if x]
    plain = [w.strip(b".,;:!?\"'()").lower() for w in words]
    symbols = len(data.translate(None, _NOT_SYMBOL)) / size
    upper = len(data.translate(None, _NOT_UPPER)) / size
    punctuation = len(data.translate(None, _NOT_PUNCTUATION)) / size
    digits = len(data.translate(None, _NOT_DIGIT)) / size
    distinct, fresh = len(set(words)) / n, len(set(lines)) / len(lines)
    common = sum(map(COMMON.__contains__, plain)) / n
    length = sum(map(len, words)) / n
    bars = data.count(b"|") / n
    shouts = data.count(b"!!") / n
    return [
        vote(symbols > 0.03, symbols < 0.01),
        vote(bars > 0.1, bars == 0),
        vote(upper > 0.25, upper < 0.08),
        vote(len(lines) > 2 and fresh < 0.7, len(lines) > 2 and fresh > 0.9),
        vote(n >= 20 and distinct < 0.4, n >= 20 and distinct > 0.55),
        vote(n >= 20 and common < 0.08, n >= 20 and common > 0.15),
        vote(length > 6.5 or length < 3.2, 4 < length < 6),
        vote(punctuation > 0.08, 0.005 < punctuation < 0.05),
        vote(shouts > 0.1, shouts == 0),
        vote(digits > 0.2, digits < 0.05),
    ]


LABELLERS = ("symbols", "bars", "capitals", "repeated_lines", "repeated_words", "common_words", "word_length", "punctuation", "shouting", "digits")


class LabelModel:
    """Two classes, each labeller independent within a class; fitted to counted patterns by EM."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS):
        k = patterns.shape[1] if len(patterns) else len(LABELLERS)
        self.prior = PRIOR_GOOD
        self.chance = np.full((2, k, 3), 1 / 3)
        if not len(patterns):
            return
        lean = (patterns == 2).sum(axis=1) - 2.0 * (patterns == 0).sum(axis=1)
        good = np.where(lean >= 0, 0.9, 0.1)
        hit = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
        for _ in range(rounds):
            before = self.prior
            for c, share in ((0, 1 - good), (1, good)):
                weight = counts * share
                self.chance[c] = (np.einsum("p,pkv->kv", weight, hit) + 0.5) / (weight.sum() + 1.5)
            self.prior = float((counts @ good + 1) / (counts.sum() + 2))
            good = self.posterior(patterns)
            if abs(self.prior - before) < 1e-9:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        if not len(patterns):
            return np.empty(0)
        k = np.arange(patterns.shape[1])
        logs = [math.log(p) + np.log(self.chance[c][k, patterns]).sum(axis=1) for c, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Chance that a labeller is right when it votes."""
        right = (1 - self.prior) * self.chance[0][:, 0] + self.prior * self.chance[1][:, 2]
        votes = right + (1 - self.prior) * self.chance[0][:, 2] + self.prior * self.chance[1][:, 0]
        return dict(zip(LABELLERS, (right / votes).tolist(), strict=True))


def bucket(feature: bytes) -> int:
    return zlib.crc32(feature) % BUCKETS


_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))


def word_buckets(word: bytes) -> tuple[int, int]:
    shape = word.translate(_SHAPE)
    short = bytes(c for i, c in enumerate(shape) if not i or c != shape[i - 1])
    return bucket(b"w" + word.lower()), bucket(b"s" + short)


def whole_buckets(data: bytes, words: list[bytes]) -> list[int]:
    """Features of the whole text: how much of it repeats, and its length."""
    lines = [x for x in data.split(b"\n") if x]
    return [
        bucket(b"distinct words %d" % int(10 * len(set(words)) / len(words))),
        bucket(b"distinct lines %d" % int(10 * len(set(lines)) / max(1, len(lines)))),
        bucket(b"words %d" % len(words).bit_length()),
    ]


class HashedScorer:
    """Logistic score of the mean of the words' weights plus the whole text's."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS)
        self.bias = 0.0
        self.prior = PRIOR_GOOD

    def fit(self, texts: list[str], good: np.ndarray, seed: int = 11) -> HashedScorer:
        self.prior = float(good.mean()) if len(good) else PRIOR_GOOD
        rows = []
        for text, y in zip(texts, good, strict=True):
            data = utf8(text)
            words = data.split()
            if words:
                ids, n = np.unique(np.array([b for w in words for b in word_buckets(w)]), return_counts=True)
                whole = whole_buckets(data, words)
                rows.append((np.concatenate([ids, whole]), np.concatenate([n / len(words), np.ones(len(whole))]), float(y)))
        draw, seen = np.random.default_rng(seed), np.full(BUCKETS, 1e-2)
        for _ in range(EPOCHS):
            for at in draw.permutation(len(rows)).tolist():
                ids, x, y = rows[at]
                z = self.weights[ids] @ x + self.bias
                error = 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) - y
                step = error * x
                seen[ids] += step * step
                self.weights[ids] -= RATE * step / np.sqrt(seen[ids])
                self.bias -= 0.01 * error
        return self

    def scorer(self):
        known: dict[bytes, float] = {}
        weights, bias, prior = self.weights, self.bias, self.prior

        def score(text: str) -> float:
            data = utf8(text)
            words = data.split()
            if not words:
                return prior
            if len(known) > MEMORY:
                known.clear()
            values = list(map(known.get, words))
            if None in values:
                for i, v in enumerate(values):
                    if v is None:
                        a, b = word_buckets(words[i])
                        values[i] = known[words[i]] = float(weights[a] + weights[b])
            z = sum(values) / len(values) + float(weights[whole_buckets(data, words)].sum()) + bias
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def voted(docs: DataFrame, text: str) -> DataFrame:
    """The votes on each text, as digits."""

    def run(batches):
        for batch in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, votes_of(t))) for t in texts_of(batch, text)], pa.string())], names=["votes"])

    return docs.select(text).mapInArrow(run, "votes string")


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> tuple[LabelModel, HashedScorer]:
    rows = voted(docs, text).groupBy("votes").count().collect()
    rows = sorted((r["votes"], r["count"]) for r in rows)
    patterns = np.array([[int(c) for c in v] for v, _ in rows], dtype=np.int64)
    labels = LabelModel(patterns, np.array([n for _, n in rows], dtype=float))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    chosen = source.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = [t for _, t in sorted((r["doc_id"], r["body"]) for r in sample_texts(source, chosen, Scratch(docs.sparkSession, "quality"), most))]
    good = labels.posterior(np.array([votes_of(t) for t in texts], dtype=np.int64).reshape(-1, len(LABELLERS)))
    return labels, HashedScorer().fit(texts, good)


def annotate(docs: DataFrame, labels: LabelModel, model: HashedScorer, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with votes (a digit for each labeller), weak_posterior and quality, and the names that these got."""
    held = docs.sparkSession.sparkContext.broadcast((labels, model))
    names = {c: free_name(docs.columns, c) for c in ("votes", "weak_posterior", "quality")}

    def run(batches):
        labels, model = held.value
        score = model.scorer()
        for batch in pieces(batches, text):
            texts = texts_of(batch, text)
            votes = [votes_of(t) for t in texts]
            weak = labels.posterior(np.array(votes, dtype=np.int64).reshape(-1, len(LABELLERS)))
            columns = [*batch.columns, pa.array(["".join(map(str, v)) for v in votes], pa.string()), pa.array(weak, pa.float64()), pa.array([score(t) for t in texts], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names.values()])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.StringType() if c == "votes" else T.DoubleType()) for c, n in names.items())])), names


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, _ = annotate(docs, *fit(docs))
    return scored.select(
        "doc_id", "votes", "weak_posterior", F.col("quality").alias("score"), (F.col("quality") >= 0.5).cast("int").alias("predicted"), (F.col("quality") >= 0.5).alias("kept")
    )
