import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from pulseframe.llm import resampling
from pulseframe.llm.common import Scratch
from pulseframe.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs_of(text, shortest, longest):
    words = words_of(text)
    return Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1))


def plain(docs, target, shortest=1, longest=1, buckets=10_000, percent=10, least=20):
    """doc_id, features, weight, score, rank of every document, one after the other."""
    def bucketed(texts):
        out = []
        for text in texts:
            held = Counter()
            for crc, n in runs_of(text, shortest, longest).items():
                held[crc % buckets] += n
            out.append(held)
        return out

    own, wanted = bucketed(t for _, t in docs), sum(bucketed(target), Counter())
    corpus = sum(own, Counter())
    every, all_wanted = sum(corpus.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1.0) * (every + buckets) / ((corpus[b] + 1.0) * (all_wanted + buckets))))
    rows = []
    for (doc, text), held in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in held.items())
        rows.append([doc, sum(held.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    for place, row in enumerate(able[: len(able) * percent // 100]):
        row[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def some_texts(n, seed=3):
    draw = random.Random(seed)
    stock = ["alpha", "Beta", "GAMMA", "d3lta", "é", "ÉTÉ", "x", "日本", "o'clock", "a\x00b", "tab\tline\nbreak", "--", "\U0001f600"] + [f"w{i}" for i in range(80)]
    return [" ".join(draw.choices(stock, k=draw.randrange(60))) for _ in range(n)]


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_equals_counting_one_by_one(spark):
    texts = some_texts(150)
    docs = [(i * 7 % 151, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " .,; "), (None, texts[3]), (None, texts[5])]
    target = [*some_texts(9, seed=8), None]
    found, _ = resampling.ranked(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows_of(found) == plain(docs, target)
    assert sum(r[4] is not None for r in rows_of(found)) > 5


@pytest.mark.parametrize("most", [60, 1 << 20])
def test_longer_runs_of_long_texts_cut_anywhere(spark, monkeypatch, most):
    cut = resampling.chunks_of
    monkeypatch.setattr(resampling, "CHUNK", most)
    monkeypatch.setattr(resampling, "chunks_of", lambda text, overlap: cut(text, overlap, most))
    texts = some_texts(40, seed=5) + ["word " * 90 + "z" * 200 + " end", "q" * 500]
    spilled = []
    for text in texts:
        body = text.encode().translate(resampling.FOLD).decode()
        held, count = resampling.counter(1, 3, 1 << 31)
        import pyarrow as pa

        parts = [(0, body)] if len(body) <= most else list(resampling.chunks_of(body, 2))
        held.register("piece", pa.table({"doc": pa.array([0] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "skip": pa.array([s for s, _ in parts], pa.int32()), "body": [b for _, b in parts]}))
        held.execute(count)
        spilled.append(dict(held.execute("SELECT bucket, n FROM found").fetchall()))
    for text, got in zip(texts, spilled, strict=True):
        wanted = Counter()
        for crc, n in runs_of(text, 1, 3).items():
            wanted[crc % (1 << 31)] += n
        assert got == wanted


def test_runs_of_two_and_three_words_and_other_buckets(spark):
    docs = list(enumerate(some_texts(60, seed=9)))
    target = some_texts(6, seed=10)
    found, names = resampling.ranked(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(t,) for t in target], "text string"), percent=30, least_words=10, lengths=(2, 3), buckets=500)
    assert rows_of(found) == plain(docs, target, 2, 3, 500, 30, 10)


def test_draws_whole_rows_with_clashing_columns(spark):
    texts = some_texts(120, seed=11)
    schema = "doc_id long, text string, score string, rank int, place string, own int, body string, weight double"
    docs = spark.createDataFrame([(i, t, "s", 1, "p", 2, "b", 0.5) for i, t in enumerate(texts)], schema).repartition(3)
    target = spark.createDataFrame([(t,) for t in some_texts(6, seed=12)], "text string")
    found, names = resampling.ranked(docs, target)
    ranks = {r.doc_id: r[names["rank"]] for r in found.collect()}
    drawn = resampling.resample(docs, target)
    assert drawn.schema == docs.schema
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(d for d, k in ranks.items() if k is not None)
    assert set(docs.columns) < set(found.columns) and names["score"] != "score" and names["rank"] != "rank"


def test_repeated_rows_are_drawn_one_by_one(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(4, text)] * 300 + [(9, "short")] * 100, SCHEMA).repartition(4)
    found, _ = resampling.ranked(docs, spark.createDataFrame([(text,)], "text string"))
    ranks = sorted(r["rank"] for r in found.collect() if r["rank"] is not None)
    assert ranks == list(range(1, 31)) and found.count() == 400
    assert resampling.resample(docs, spark.createDataFrame([(text,)], "text string")).count() == 30


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.ranked(none, target)[0].collect() == []
    assert resampling.resample(none, target).collect() == []
    docs = [(1, "a b c"), (2, None)]
    assert rows_of(resampling.ranked(spark.createDataFrame(docs, SCHEMA), target)[0]) == plain(docs, [])


def test_positions_are_those_of_a_sort(spark):
    from pulseframe.llm.common import positions
    from pyspark.sql import functions as F

    values = [(random.Random(i).randrange(40), i) for i in range(500)]
    df = spark.createDataFrame(values, "a int, b int").repartition(7)
    placed, place = positions(df, [F.col("a").desc(), F.col("b").asc()], Scratch(spark, "test"), "p")
    got = {(r.a, r.b): r[place] for r in placed.collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, key=lambda v: (-v[0], v[1])))}


def test_registered():
    assert "op11_resampling" in QUERIES and "op11_resampling" in SQL
