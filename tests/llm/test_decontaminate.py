import random

import numpy as np
import pytest

from pulseframe.llm import decontaminate as D
from tests.llm.helpers import contamination

DOCS = "doc_id long, text string, N_WORDS string"
ITEMS = "item_id long, text string"


def cases(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "naïve", "Q1", "日本"]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, say(draw.choice([1, 3, 12, 13, 14, 40]))) for i in range(2, 14)] + [(100, None), (101, "..!"), (102, "W1 w2"), (103, "w1-W2")]
    docs = []
    for i in range(60):
        parts = [say(draw.choice([0, 2, 30]))]
        for _ in range(draw.randrange(3)):
            body = draw.choice(items)[1] or ""
            cut = body.split(" ")
            parts += [" ".join(cut[draw.randrange(3) :]), say(draw.choice([0, 1, 200]))]
        docs.append((i, draw.choice(["\n", " ", ", ", "\x00"]).join(parts), None))
    return docs + [(900, None, "x"), (901, "", "x"), (902, "w1 " * 30_000, "x"), (902, "w1 " * 30_000, "x")], items


def got(df):
    hit = D.n_hit(D.F.col("hit_spans"))
    rows = df.select("doc_id", "text", df.columns[-3], hit.alias("h"), D.F.size("hit_items").alias("i"), D.F.sha2(D.F.array_join(D.F.array_sort("hit_items"), ","), 256).alias("s"), D.contaminated(D.F.col(df.columns[-3]), hit).alias("c"))
    return sorted((r[0], *r[2:]) for r in rows.collect())


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_equals_plain_search(spark, monkeypatch, block_chars):
    monkeypatch.setattr(D.item_blocks, "__defaults__", (block_chars,))
    docs, items = cases(3)
    found, names = D.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert names["n_words"] == "_n_words"
    assert got(found) == sorted((d, *contamination(t, items)) for d, t, _ in docs)


def test_one_stage_whatever_the_benchmarks_size(spark, monkeypatch):
    monkeypatch.setattr(D.item_blocks, "__defaults__", (60,))
    docs, items = cases(3)
    found, _ = D.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_indexes_of_few_words(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 50)
    docs, items = cases(5)
    blocks = [D.Windows([(str(i), D.words_of(t or "")) for i, t in part]) for part in (items[:6], items[6:])]
    n_words, spans, hit = D.search_texts(lambda: blocks, [t or "" for _, t, _ in docs])
    for (_, text, _), n, own, names in zip(docs, n_words, spans, hit, strict=True):
        assert (n, sum(b - a for a, b in own), len(names)) == contamination(text, items)[:3]


def test_long_items_only(spark):
    draw = random.Random(8)
    vocabulary = [f"v{i}" for i in range(9)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(40))) for i in range(6)]
    docs = [(i, " ".join([*(draw.choice(vocabulary) for _ in range(50)), *items[i % 6][1].split()[: 10 + i % 9]]), None) for i in range(40)]
    found, _ = D.annotate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert got(found) == sorted((d, *contamination(t, items)) for d, t, _ in docs)


def test_empty_tables(spark):
    docs, items = cases(4)
    none = spark.createDataFrame([], ITEMS)
    assert D.drop_contaminated(spark.createDataFrame(docs, DOCS), none).count() == len(docs)
    assert D.annotate(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS))[0].collect() == []


def test_stage_returns_the_columns_of_its_input(spark):
    docs, items = cases(3)
    kept = D.drop_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert kept.columns == ["doc_id", "text", "N_WORDS"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t, _ in docs if not contamination(t, items)[-1])


def test_index_by_itself():
    draw = np.random.default_rng(2)
    tokens = np.append(draw.integers(0, 5, 400), 0)
    index = D.FMIndex(tokens, 5, sample=4)
    for n in (1, 2, 3, 5):
        patterns = draw.integers(1, 5, (30, n))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(tokens) - n + 1) if (tokens[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
