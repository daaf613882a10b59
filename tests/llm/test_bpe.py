import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from pulseframe.llm import bpe

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.vocabulary(None, None))


def odd_texts():
    draw = random.Random(1)
    kinds = [(32, 127), (0, 0x300), (0x2000, 0x2100), (0x4E00, 0x4F00), (0x1F300, 0x1F600)]
    texts = ["", " ", "a" * 5000, "ab" * 4000, " " * 700 + "x", "don't WE'LL it's\n\n\n x\t\t", "a\x1cb \x1d c", "\x85\xa0 x　y ​ z﻿", "½ Ⅷ ① ٣ é"]
    for _ in range(150):
        texts.append("".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(draw.randrange(120))))
    return texts


def test_equals_the_tokenizer_library(codec):
    ours = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in odd_texts():
        ids = ours.encode_ordinary(text)
        assert codec.encode(text) == ids and codec.decode(ids) == text.encode()
        assert codec.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_leftmost_pair_of_least_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaaa": 258, b"ba": 259}
    own = bpe.Codec(ranks, r"\S+|\s+")
    assert own.encode_piece(b"aaa") == [256, 97]
    assert own.encode_piece(b"aaaab") == [258, 98]
    assert own.encode_piece(b"baab") == [98, 256, 98]


def test_tables(spark):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (2, None, "x"), (None, "a", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    encoded, name = bpe.encode(docs)
    back, bytes_name = bpe.decode(encoded, name)
    assert (name, bytes_name) == ("_ids", "decoded")
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert sorted(r.n_tokens for r in bpe.digests(docs).collect()) == [0, 0, 1, 3]
    assert bpe.digests(spark.createDataFrame([], SCHEMA)).collect() == []
