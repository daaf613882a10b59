import math
import random
import zlib

import numpy as np

from pulseframe.llm import toxicity as X


def corpus(n=700, seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeghilmnoprstu") for _ in range(draw.randrange(2, 9)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(draw.randrange(5, 120))]
        toxic = int(draw.random() < 0.25)
        if toxic:
            for _ in range(1 + len(words) // 40):
                words.insert(draw.randrange(len(words)), draw.choice(["wretchling", "gormless", "numbskull"]) + draw.choice(["", "s", "!", ".", "ed"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_learns_and_meets_misspellings(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "l") for i, t, _ in rows], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    scored, name = X.annotate(docs, model)
    assert name == "_toxicity"
    held = [(r[name], dict((i, y) for i, _, y in rows)[r.doc_id]) for r in scored.filter(X.crc_mod(X.F.col("doc_id"), 5) == 0).collect()]
    assert sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.93
    score = model.scorer()
    assert score("well numbskul then wretchlng and gormles") > score("well number then wrestling and gorgeous")
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0.6 * len(rows) < kept.count() < 0.9 * len(rows)


def test_nulls_empty_tables_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "words here", None), (3, "", "x"), (4, "w" * 200_000, "x")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.drop_toxic(docs, none).count() == 5
    odd = spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    scored, name = X.annotate(docs, X.fit(docs, odd))
    assert all(0 <= r[name] <= 1 for r in scored.collect()) and scored.count() == 5
    assert X.annotate(spark.createDataFrame([], docs.schema), X.SubwordSoftmax())[0].collect() == []


def test_first_epoch_sees_every_passage():
    draw = random.Random(4)
    long = ["".join(draw.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(1200)]
    texts, labels = [" ".join(long), "short and clean", "one vile churl here"], [0, 0, 1]
    before, after = X.SubwordSoftmax().embeddings, X.SubwordSoftmax().fit(texts, labels, epochs=1).embeddings
    moved = (before != after).any(axis=1)
    assert all(moved[X.subwords(w)].any() for text in texts for w in X.words_of(text))


def plain_loss(model, texts, labels):
    """Weighted cross-entropy of single passages, by loops in double precision."""
    share = sum(labels) / len(labels)
    total = 0.0
    for text, y in zip(texts, labels, strict=True):
        words = X.words_of(text)
        mean = sum(sum(model.embeddings[b].astype(float) for b in X.subwords(w)) / len(X.subwords(w)) for w in words) / len(words)
        z = [float(mean @ model.softmax[:, c].astype(float)) + float(model.bias[c]) for c in (0, 1)]
        total += (math.log(sum(map(math.exp, z))) - z[y]) * 0.5 / (share if y else 1 - share)
    return total / len(texts)


def test_steps_follow_the_gradient():
    texts, labels = ["mean old churl", "good day to", "kind words here", "vile churl"], [1, 0, 0, 1]
    before, after = X.SubwordSoftmax(), X.SubwordSoftmax().fit(texts, labels, epochs=1)  # one batch
    word = X.subwords(b"churl")
    for store, damping, at in [("embeddings", X.DAMPING, (b, k)) for b in word[:4] for k in range(X.DIM)] + [("softmax", 1e-6, (k, c)) for k in range(X.DIM) for c in (0, 1)]:
        step = float(getattr(before, store)[at]) - float(getattr(after, store)[at])
        found = math.copysign(math.sqrt(step**2 * damping / (X.RATE**2 - step**2)), step)
        losses = []
        for h in (1e-3, -1e-3):
            model = X.SubwordSoftmax()
            getattr(model, store)[at] += h
            losses.append(plain_loss(model, texts, labels))
        slope = (losses[0] - losses[1]) / 2e-3
        assert abs(found - slope) < 0.03 * abs(slope) + 2e-4, (store, at)


def test_query_equals_plain_scores(spark, tmp_path):
    rows = corpus(160) + [(900, None, 0), (901, " ", 1), (902, "numbskull " * 9000, 1)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    train = [(i, t or "", y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    model = X.SubwordSoftmax().fit([t for _, t, _ in train], [y for _, _, y in train])
    got = X.op8_toxicity(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, (i, text, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        lean = (model.softmax[:, 1] - model.softmax[:, 0]).astype(float)
        numbers = [np.mean([model.embeddings[b].astype(float) @ lean for b in X.subwords(w)]) for w in X.words_of(text or "")]
        passages = [np.mean(numbers[a : a + X.PASSAGE]) for a in range(0, len(numbers), X.PASSAGE)]
        want = 1 / (1 + math.exp(model.offset - max(passages))) if passages else min(model.base, 0.499999)
        assert (r.doc_id, r.held_out, r.predicted) == (i, zlib.crc32(str(i).encode()) % 5 == 0, int(r.score >= 0.5)) and abs(r.score - want) < 1e-4
