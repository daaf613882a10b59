import random
from collections import defaultdict

import pytest

from pulseframe.llm import suffix_dedup as S
from tests.llm.helpers import without_repeats

SCHEMA = "doc_id long, text string, id string"


def corpus(seed):
    draw = random.Random(seed)
    say = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    passages = [say(draw.choice([200, 390, 399, 400, 401, 430, 800])) for _ in range(8)]
    texts = []
    for _ in range(70):
        parts = [say(draw.choice([0, 3, 150, 500]))]
        for _ in range(draw.randrange(4)):
            parts += [draw.choice(passages), say(draw.choice([0, 1, 60]))]
        texts.append("".join(parts))
    texts += texts[:6]
    near = say(2500)
    for _ in range(14):
        copy = list(near)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = draw.choice("xyz")
        texts.append("".join(copy))
    texts += ["q" * 399, "q" * 1200, "ab" * 700, passages[0] * 3, None, ""]
    return texts


def got(spark, texts):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    rows = S.RepeatedPassages(docs).kept().collect()
    import hashlib

    return [(r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("hot", [2000, 1])
def test_equals_counting_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    for seed in (1, 2):
        texts = corpus(seed)
        assert got(spark, texts) == without_repeats(texts, S.SPAN)


def test_pieces_of_a_long_text(monkeypatch):
    draw = random.Random(9)
    data = "".join(draw.choice("ab") for _ in range(5000)).encode()
    codes = S.of_bytes().codes(data)
    whole = S.anchors_of(codes)
    monkeypatch.setattr(S, "PIECE", 700)
    parts = S.anchors_of(codes)
    spread = lambda a: [(p, i) for p, f, z in zip(*map(list, a), strict=True) for i in range(f, z + 1)]
    assert spread(whole) == spread(parts)


def test_merge_gives_order_and_common_prefixes():
    draw = random.Random(4)
    runs = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randrange(1, 30))) for _ in range(draw.randrange(40))) for _ in range(7)]
    coded = [[(S.common_prefix(a, b), b[S.common_prefix(a, b) :], b) for a, b in zip([b"", *r], r, strict=False)] for r in runs]
    merged = list(S.LcpLoserTree(coded))
    assert [m[1] for m in merged] == sorted(x for r in runs for x in r) == [m[2] for m in merged]
    assert [m[0] for m in merged[1:]] == [S.common_prefix(a[1], b[1]) for a, b in zip(merged, merged[1:], strict=False)]


def test_repeated_rows_nulls_and_empty(spark):
    text = "".join(random.Random(3).choice("abcd") for _ in range(900))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text[:450], "x"), (2, None, None), (None, text[:300], None)], SCHEMA)
    rows = sorted((r.n_bytes, r.n_removed) for r in S.RepeatedPassages(docs).kept().collect())
    assert rows == [(0, 0), (300, 0), (450, 450), (900, 900), (900, 900)]
    assert S.RepeatedPassages(spark.createDataFrame([], SCHEMA)).kept().collect() == []


def passages(texts, least):
    """Runs and words that strings of ``least`` words cover which another document has."""
    words = [(t or "").split() for t in texts]
    holders = defaultdict(set)
    for i, own in enumerate(words):
        for at in range(len(own) - least + 1):
            holders[tuple(own[at : at + least])].add(i)
    out = []
    for own in words:
        hit = [False] * len(own)
        for at in range(len(own) - least + 1):
            if len(holders[tuple(own[at : at + least])]) > 1:
                hit[at : at + least] = [True] * least
        out.append((sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit)), sum(hit)))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_passages_of_other_documents(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    draw = random.Random(8)
    say = lambda n: " ".join(draw.choice(["a", "be", "sea", "dé"]) for _ in range(n))
    known = [say(n) for n in (40, 50, 51, 52, 70, 200)]
    texts = [f"{say(draw.choice([0, 3, 60]))} {draw.choice(known)} {say(draw.choice([0, 1, 90]))}" for _ in range(40)]
    texts += ["x " * 200, "x " * 40, f"{known[4]}\n{known[4]}", "y " * 300, None, "", texts[0], " ".join(known[5].split()[:51])]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.n_passages, r.passage_words, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op10_suffix_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [a + b for a, b in zip(passages(texts, S.PASSAGE), without_repeats(texts, S.SPAN), strict=True)]


def test_hot_keys_are_joined_apart(spark):
    from pyspark.sql import functions as F

    from pulseframe.llm.common import join_apart, marked_apart

    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"), "id")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.max("id").alias("top")).filter("k % 2 = 1")
    got = sorted(map(tuple, join_apart(rows, keys, ["k"], "size").select("k", "id", "top").collect()))
    assert got == sorted(map(tuple, rows.join(keys, "k").select("k", "id", "top").collect()))
    assert join_apart(rows.limit(0), keys.limit(0), ["k"], "size").collect() == []
    told = {r.id: r.seen for r in marked_apart(rows, keys, ["k"], "size", "seen").collect()}
    assert len(told) == 3000 and all(seen == (i < 1500 or i % 2 == 1) for i, seen in told.items())
    assert marked_apart(rows, keys.limit(0), ["k"], "size", "seen").filter("seen").count() == 0
