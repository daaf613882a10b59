import random

from tests.llm.helpers import near_components
from pulseframe.llm.minhash import NearDuplicates, components, drop_near_copies
from pulseframe.llm.common import Scratch

SCHEMA = "doc_id long, text string, component_id string"


def corpus(seed=5):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(draw.choice([3, 5, 6, 20, 28, 60, 200, 400]))]
        if draw.random() < 0.4:
            base += passage
        out.append(base)
        for _ in range(draw.choice([0, 1, 2, 12])):
            copy = list(draw.choice(out[-3:]))
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = word()
            out.append(copy)
    draw.shuffle(out)
    rows = [(i, draw.choice([" ", "\n", "\t "]).join(w.upper() if draw.random() < 0.1 else w for w in words), None) for i, words in enumerate(out)]
    return rows + [(9001, None, "x"), (9002, " \n", "x"), (9003, "", "x"), (9004, "One two", "x"), (9005, "one  TWO", "x"), (9006, "z" * 300_000, "x")]


def test_components_equal_all_pairs(spark):
    for seed in (5, 6):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA)).result().collect()}
        want = near_components([(d, t) for d, t, _ in rows])
        assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def crowds(draw, groups):
    """Copies of a text each, some words of them changed and the end cut off: (size, copies, changes of 60 words)."""
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows = []
    for size, copies, changes in groups:
        base = [word() for _ in range(size)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(draw.choice(changes) * size // 60):
                copy[draw.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy[: len(copy) - draw.choice([0, 0, 0, 2, 5])]), None))
    return rows


def test_crowded_lists_lose_no_link(spark):
    rows = crowds(random.Random(11), [(60, 60, [0, 1, 1, 2, 2, 3, 5, 9]), (130, 60, [0, 1, 1, 2, 2, 3, 5, 9]), (1500, 12, [0, 1, 1, 2])])
    got = {r.doc_id: r.component_id for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA)).result().collect()}
    assert got == {d: c for d, (_, c) in near_components([(d, t) for d, t, _ in rows]).items()}


def test_copies_of_copies_lose_no_link(spark):
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    texts = [[word() for _ in range(90)]]
    for _ in range(80):
        copy = list(draw.choice(texts[-4:]))
        copy[draw.randrange(len(copy))] = word()
        texts.append(copy)
    rows = [(i, " ".join(t), None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA)).result().collect()}
    assert got == {d: c for d, (_, c) in near_components([(d, t) for d, t, _ in rows]).items()}


def test_pairs_follow_the_rows_of_a_crowd(spark):
    rows = crowds(random.Random(13), [(140, 2500, [0, 1, 2, 3, 4, 5])])
    near = NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    compared = sum(spark.read.parquet(near.scratch.path(name)).count() for name in ("hub_pairs", "pairs"))
    assert compared < 3 * len(rows)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.id: r.component for r in components(Scratch(spark, "test"), edges, "c").collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_empty_null_and_repeated_rows(spark):
    assert NearDuplicates(spark.createDataFrame([], SCHEMA)).result().collect() == []
    text = "a b c d e f g h"
    rows = [(4, text, None), (4, text, None), (None, text, None), (None, "q r s t u v", None), (3, text + " ", None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in NearDuplicates(spark.createDataFrame(rows, SCHEMA)).result().collect()), key=repr)
    assert got == sorted([(4, 3, False), (4, 3, False), (None, 3, False), (None, None, True), (3, 3, True)], key=repr)
    kept = drop_near_copies(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [(3, text + " ")] and kept.columns == ["doc_id", "text", "component_id"]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["q r s t u v"]


def test_stage_decides_by_row(spark):
    text, other = "one two three", "four five six"
    rows = [(3, text, None), (5, text, None), (5, other, None), (None, text, None), (None, "", None), (7, None, None), (8, other, None), (5, other, None)]
    got = sorted(((r.doc_id, r.text) for r in drop_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted([(3, text), (5, other), (None, ""), (7, None)], key=repr)
