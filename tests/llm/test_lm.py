import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pulseframe.llm import lm

SCHEMA = "doc_id long, text string, train string"


class PlainTree:
    """Context-tree weighting as its definition has it, one node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for body in texts:
            data = bytes([255]) * depth + body + b"\xff"
            for i in range(depth, len(data)):
                for d in range(depth + 1):
                    node = 1
                    for level in range(8):
                        bit = data[i] >> (7 - level) & 1
                        cell = self.n.setdefault((data[i - d : i], node), [0, 0])
                        cell[bit] += 1
                        node = 2 * node + bit
        self.pw = {}
        for context, node in sorted(self.n, key=lambda x: -len(x[0])):
            own = self.own(context, node)
            if len(context) == depth:
                self.pw[context, node] = own
            else:
                rest = sum(self.pw.get((bytes([c]) + context, node), 0.0) for c in range(256))
                self.pw[context, node] = np.logaddexp(own, rest) - math.log(2)

    def own(self, context, node):
        a, b = self.n.get((context, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    def log10(self, body):
        data, total = bytes([255]) * self.depth + body + b"\xff", 0.0
        for i in range(self.depth, len(data)):
            node = 1
            for level in range(8):
                bit, p = data[i] >> (7 - level) & 1, None
                for d in range(self.depth, -1, -1):
                    key = (data[i - d : i], node)
                    a, b = self.n.get(key, (0, 0))
                    kt = ((b if bit else a) + 0.5) / (a + b + 1)
                    weight = math.exp(self.own(*key) - math.log(2) - self.pw.get(key, 0.0)) if d < self.depth else 1.0
                    p = kt if p is None else weight * kt + (1 - weight) * p
                total += math.log10(p)
                node = 2 * node + bit
        return total


def corpus(seed=1):
    draw = random.Random(seed)
    texts = [" ".join(draw.choice(["the", "cat", "Sat", "on", "maté", "x" * draw.randrange(1, 4)]) for _ in range(draw.randrange(12))) for _ in range(40)]
    return list(enumerate([*texts, None, "", "only here", "éé"]))


def test_equals_the_definition(spark):
    rows = corpus()
    train = [(t or "").encode().lower() for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    plain = PlainTree(train, lm.DEPTH)
    count = Counter(w for t in train for w in t.split())
    n, v = sum(count.values()) + len(train), len(count) + 1
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: r for r in lm.ContextTreeModel(docs, block_bytes=200).scored().collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        body = (t or "").encode().lower()
        tokens = [count[w] for w in body.split()] + [len(train)]
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (len(tokens), sum(c > 0 for c in tokens), n, zlib.crc32(str(d).encode()) % 7 != 2)
        assert math.isclose(r.base_score, sum(math.log10((c + 1) / (n + v + 1)) for c in tokens), rel_tol=1e-9)
        assert math.isclose(r.score, plain.log10(body), rel_tol=1e-9)


def test_no_training_rows_repeats_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = lm.ContextTreeModel(spark.createDataFrame([(held, "ab", "x"), (held, "ab", "x")], SCHEMA)).scored().collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in rows] == [(3 - 1, 0, 0)] * 2
    assert all(math.isclose(r.score, 24 * math.log10(0.5)) and math.isclose(r.base_score, 0.0) for r in rows)
    assert lm.ContextTreeModel(spark.createDataFrame([], SCHEMA)).scored().collect() == []
    assert lm.ContextTreeModel(spark.createDataFrame([(None, "a", None), (1, "b" * 300_000, None)], SCHEMA)).scored().count() == 2


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 3, 10.5, 1e4, 1e9])
    assert np.allclose(lm.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_contexts_of_six_bytes_count(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["abcdeX", "bbcdeY", "abcdez"]) + "12345"[: draw.randrange(6)] for _ in range(6)) for _ in range(30)]
    rows = list(enumerate(texts))
    plain = PlainTree([t.encode().lower() for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2], 6)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.score for r in lm.ContextTreeModel(docs, block_bytes=300).scored().collect()}
    assert all(math.isclose(got[d], plain.log10(t.encode().lower()), rel_tol=1e-9) for d, t in rows)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_held_out_texts_are_likelier_than_by_the_base(spark):
    held = lm.op2_context_tree(spark, "/root/testdata/sf0.1").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > 0.95 * held["sum(base_score)"]


def test_stretches_of_a_text_are_its_grams():
    for body in (b"", b"a", bytes(range(256)) * 3, b"ab" * 500):
        whole, sizes = lm.grams_of([body])
        assert sizes.tolist() == [len(body) + 1]
        for most in (1, 7, 64, 10_000):
            parts = list(lm.gram_stretches(body, most=most))
            assert np.array_equal(np.concatenate(parts), whole) and max(map(len, parts)) <= most


def test_a_text_of_several_stretches(spark):
    """Two texts of some MB, one the other's beginning: their scores differ by what follows, which is all known."""
    unit = "the cat sat on the mat and saw the hat of the other cat "
    long, longer = unit * 60_000, unit * 90_000
    docs = spark.createDataFrame([(1, long), (2, longer), (3, unit)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.ContextTreeModel(docs).scored().collect()}
    assert len(long) > lm.CHUNK_BYTES and got[1].n_bytes == len(long) and got[2].n_tokens == 90_000 * 14 + 1
    per_unit = (got[2].score - got[1].score) / 30_000
    assert per_unit < 0 and got[1].score == pytest.approx(got[2].score - 30_000 * per_unit, rel=1e-9)
    assert got[1].score == pytest.approx(60_000 * per_unit, abs=20)  # its first and last bytes are rare
