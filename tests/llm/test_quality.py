import math
import random
from collections import Counter

import numpy as np

from pulseframe.llm import quality as Q


def test_em_finds_accuracies_of_labellers():
    draw = np.random.default_rng(4)
    truth = draw.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(draw.random(len(truth)) < 0.3, 1, np.where(draw.random(len(truth)) < p, 2 * truth, 2 * ~truth)) for p in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.LabelModel(patterns, counts.astype(float))
    found = [(1 - model.prior) * c0[0] + model.prior * c1[2] for c0, c1 in zip(*model.chance, strict=True)]
    assert np.allclose(np.array(found) / 0.7, right, atol=0.03) and abs(model.prior - 0.8) < 0.02


def corpus(seed=2):
    draw = random.Random(seed)
    word = lambda: draw.choice(["the", "of", "and", "is"]) if draw.random() < 0.3 else "".join(draw.choice("aeinorst") for _ in range(draw.randrange(3, 9)))
    rows = []
    for i in range(400):
        words, bad = [word() for _ in range(draw.randrange(25, 120))], i % 5 == 0
        if bad:
            kind = i % 3
            words = [w + "$$$" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [x for w in words for x in (w, "|")]
        rows.append((i, " ".join(words) + ".", bad))
    return rows


def test_posterior_and_scorer_agree_with_the_truth(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, quality string")
    scored, names = Q.annotate(docs, *Q.fit(docs))
    assert names["quality"] == "_quality"
    bad = {i: b for i, _, b in rows}
    for name in (names["weak_posterior"], names["quality"]):
        assert sum((r[name] < 0.5) == bad[r.doc_id] for r in scored.collect()) / len(rows) > 0.97


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x"), (2, "x"), (3, "y" * 300_000)], "doc_id long, text string")
    scored, names = Q.annotate(docs, *Q.fit(docs))
    assert scored.count() == 5 and all(0 <= r[n] <= 1 for r in scored.collect() for n in (names["weak_posterior"], names["quality"]))
    none = spark.createDataFrame([], docs.schema)
    assert Q.annotate(none, *Q.fit(none))[0].collect() == []


def test_long_words_are_told_apart():
    a, b = Q.word_buckets(b"w" * 64 + b"one"), Q.word_buckets(b"w" * 64 + b"two")
    assert a[0] != b[0] and Q.word_buckets(b"a-" * 8 + b"a")[1] != Q.word_buckets(b"a-" * 8 + b"9")[1]


def plain_em(votes, rounds):
    """Expectation-maximisation over documents, one at a time, by the definition."""
    k = range(len(votes[0]))
    prior, good = Q.PRIOR_GOOD, [0.9 if v.count(2) >= 2 * v.count(0) else 0.1 for v in votes]
    for _ in range(rounds):
        before = prior
        chance = [[[0.5] * 3 for _ in k] for _ in (0, 1)]
        for v, g in zip(votes, good, strict=True):
            for i in k:
                chance[0][i][v[i]] += 1 - g
                chance[1][i][v[i]] += g
        for c, share in ((0, sum(1 - g for g in good)), (1, sum(good))):
            chance[c] = [[x / (share + 1.5) for x in row] for row in chance[c]]
        prior = (sum(good) + 1) / (len(good) + 2)
        good = []
        for v in votes:
            p = [q * math.prod(chance[c][i][v[i]] for i in k) for c, q in ((0, 1 - prior), (1, prior))]
            good.append(p[1] / (p[0] + p[1]))
        if abs(prior - before) < 1e-9:
            break
    return good


def plain_scores(texts, good):
    """The logistic scorer by dictionaries and loops: features, training in the same order, scores."""

    def features(text):
        data = text.encode()
        words = data.split()
        out = Counter()
        for w in words:
            for b in Q.word_buckets(w):
                out[b] += 1 / len(words)
        return words and (out, Q.whole_buckets(data, words))

    weights, seen, bias = Counter(), {}, 0.0
    known = [features(t) for t in texts]
    rows = [(f, y) for f, y in zip(known, good, strict=True) if f]
    line = lambda f: sum(weights[b] * x for b, x in f[0].items()) + sum(weights[b] for b in f[1]) + bias
    draw = np.random.default_rng(11)
    for _ in range(Q.EPOCHS):
        for at in draw.permutation(len(rows)).tolist():
            f, y = rows[at]
            error = 1 / (1 + math.exp(-line(f))) - y
            for b, x in [*f[0].items(), *((b, 1.0) for b in f[1])]:
                seen[b] = seen.get(b, 1e-2) + (error * x) ** 2
                weights[b] -= Q.RATE * error * x / math.sqrt(seen[b])
            bias -= 0.01 * error
    prior = sum(good) / len(good)
    return [1 / (1 + math.exp(-line(f))) if f else prior for f in known]


def test_query_equals_plain_loops(spark, tmp_path):
    rows = [(i, t) for i, t, _ in corpus()[:150]] + [(900, None), (901, ""), (902, "z" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [t or "" for _, t in rows]
    votes = [Q.votes_of(t) for t in texts]
    good = plain_em(votes, Q.ROUNDS)
    got = Q.op4_quality(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.votes for r in got] == ["".join(map(str, v)) for v in votes]
    assert np.allclose([r.weak_posterior for r in got], good, atol=1e-6)
    assert np.allclose([r.score for r in got], plain_scores(texts, good), atol=1e-4)
    assert all(r.kept == (r.score >= 0.5) == bool(r.predicted) for r in got)
