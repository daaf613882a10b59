import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from pulseframe.llm import packing
from pulseframe.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return own


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return packing.Encoder(file.read())


def odd_texts():
    draw = random.Random(2)
    kinds = [(32, 127), (9, 14), (0, 0x300), (0x2000, 0x2100), (0x4E00, 0x4F00), (0x1F300, 0x1F600)]
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "don't WE'LL it's x's.", "end.\nNext, line\n\nfar", "a\x1cb \x1d c", "\x85 \xa0 x　y", "ªº µ × ÷ ß", "<|endoftext|> a <|endoftext|>", "a" * 3000, "1 2 3 45.6 -- ...!", "é.\nÈà!? ü;", "tab\tx y\tz", "ﬁ ǅ ʰ"]
    for _ in range(200):
        texts.append("".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(draw.randrange(90))))
    return texts


def test_ids_are_the_librarys(encoder, library, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 40)
    monkeypatch.setattr(packing, "MEMORY", 60)
    for text in odd_texts() + [" ".join(odd_texts()[18:90])]:
        assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_ids_of_many_texts_at_once(encoder, library, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    texts = [*odd_texts(), None, "plain words, only single spaces here", "two\nlines of them", "ends with a line\n", "", None]
    for got, text in zip(encoder.encode_all(pa.array(texts, pa.string())), texts, strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert encoder.encode_all(pa.array([], pa.string())) == [] and encoder.encode_all(pa.array([None], pa.string())) == [b""]


def one_by_one(lengths, limit):
    """Remaining capacities after best-fit decreasing, piece by piece."""
    left = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= length]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= length
        else:
            left.append(limit - length)
    return sorted(left)


def filled(runs):
    held = defaultdict(list)
    for length, _, count, each, sequence, offset in runs:
        for i in range(count):
            held[sequence + i // each].append((offset + i % each * length, length))
    return held


def gapless(parts, limit):
    at = 0
    for offset, length in sorted(parts):
        assert offset == at
        at += length
    assert at <= limit
    return limit - at


def test_plan_equals_packing_one_by_one():
    for seed in range(200):
        draw = random.Random(seed)
        limit = draw.choice([1, 7, 16, 50, 1024])
        lengths = [max(1, draw.randint(1, limit) // draw.choice([1, 1, 2, 5, 9])) for _ in range(draw.randrange(120))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        runs, used = packing.best_fit(histogram, limit)
        held = filled(runs)
        assert len(held) == used and sorted(gapless(p, limit) for p in held.values()) == one_by_one(lengths, limit)
        for n in histogram:  # each piece of a length is placed once
            own = sorted((first, count) for length, first, count, *_ in runs if length == n)
            assert [f for f, _ in own] == [sum(c for _, c in own[:i]) for i in range(len(own))] and sum(c for _, c in own) == histogram[n]


def test_tightest_capacity():
    tree, held, draw = packing.Capacities(20), [0] * 21, random.Random(5)
    for _ in range(2000):
        c = draw.randint(0, 20)
        if held[c] and draw.random() < 0.6:
            tree.take(c)
            held[c] -= 1
        else:
            tree.put(c, 0, 1)
            held[c] += 1
        need = draw.randint(1, 20)
        assert tree.tightest(need) == next((r for r in range(need, 21) if held[r]), None)


def test_plan_of_a_billion_pieces_is_small():
    draw = random.Random(6)
    histogram = {n: draw.randrange(2_000_000) for n in range(1, 1025)}
    runs, used = packing.best_fit(histogram)
    total = sum(n * c for n, c in histogram.items())
    assert len(runs) < 20_000 and used < 1.01 * total / 1024


def test_pieces_and_sequences(spark, library):
    limit = 32
    texts = [None, "", *odd_texts(), " ".join(f"word{i}" for i in range(900))] + ["same text here."] * 40
    docs = [(None if i == 7 else i if i < 240 else 500, t) for i, t in enumerate(texts)]
    tokenised = packing.tokenise(spark.createDataFrame(docs, SCHEMA).repartition(5), limit=limit)
    packed, names = packing.pack(tokenised, limit)
    rows = packed.collect()
    by_doc, wanted = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, tuple(r.ids)))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        rest = len(ids) % limit
        begins = ([0] if rest else []) + list(range(rest, len(ids), limit))
        wanted[doc] += [(k, a, tuple(ids[a:b])) for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)], strict=True))]
    assert {d: sorted(p) for d, p in by_doc.items()} == {d: sorted(p) for d, p in wanted.items()}
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(gapless(p, limit) for p in held.values()) == one_by_one([r.length for r in rows], limit)
    joined = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert joined[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)


def test_query_on_a_whole_table(spark, tmp_path, library):
    texts = odd_texts() + [" ".join(f"word{i} and more" for i in range(2000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = QUERIES["op13_packing"](spark, f"file://{tmp_path}").collect()
    assert sum(r.length for r in rows) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    assert len({r.sequence_id for r in rows}) == len(one_by_one([r.length for r in rows], 1024))
    assert rows[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_lengths_out_of_range_clashing_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, 5, "a"), (1, 1, None, "b"), (2, 0, 0, "c"), (3, 0, 99, "d"), (4, 0, 5, "e")], "doc_id int, piece int, length int, sequence_id string")
    packed, names = packing.pack(rows, 10)
    assert names == {"sequence_id": "_sequence_id", "offset": "offset"}
    got = {(r.doc_id, r.piece): (r["_sequence_id"], r.offset) for r in packed.collect()}
    assert got == {(1, 0): (0, 0), (4, 0): (0, 5), (1, 1): (None, None), (2, 0): (None, None), (3, 0): (None, None)}
    none = packing.tokenise(spark.createDataFrame([], SCHEMA))
    assert packing.pack(none)[0].collect() == [] and packing.sequences(packing.pack(none)[0]).collect() == []
