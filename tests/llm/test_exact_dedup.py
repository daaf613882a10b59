import hashlib

from pyspark.sql import functions as F

from pulseframe.llm.exact_dedup import ExactDedup, drop_copies, grow_directory

SCHEMA = "doc_id long, text string, lang string, KEY string"
ROWS = [(1, "a", "x", "k"), (2, "a", "x", "k"), (3, "b", "x", None), (4, None, None, None), (5, "", "x", "k"), (6, "A", "x", "k"), (7, "a ", "x", "k"), (None, "b", "x", "k"), (8, "w " * 40_000, "x", "k"), (9, "w " * 40_000, "x", "k")]


def expected(rows):
    out = []
    for doc_id, text, *_ in rows:
        same = [r[0] for r in rows if (r[1] or "") == (text or "")]
        keep = max((i for i in same if i is not None), default=None)
        out.append((doc_id, keep, len(same), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def test_groups_nulls_and_long_texts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert got(ExactDedup(docs).decisions()) == expected(ROWS)


def test_colliding_keys_are_told_apart_by_their_bytes(spark):
    rows = [(i, f"text {i % 7}", None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    one_key = ExactDedup(docs, key=lambda c: F.lit(5).cast("long"), bucket=2)
    assert one_key.depth == 16 and got(one_key.decisions()) == expected(rows)
    few_keys = ExactDedup(docs, key=lambda c: F.pmod(F.length(c) + F.xxhash64(c), F.lit(3)), bucket=1)
    assert got(few_keys.decisions()) == expected(rows)


def test_splits_and_empty_table(spark):
    rows = [(i, f"text {i}", None, None) for i in range(500)]
    index = ExactDedup(spark.createDataFrame(rows, SCHEMA), bucket=16)
    sizes = [r["count"] for r in index.index.groupBy("bucket").count().collect()]
    assert max(sizes) <= 16 and sum(sizes) == 500 and len(index.directory) == 1 << index.depth
    assert got(ExactDedup(spark.createDataFrame([], SCHEMA)).decisions()) == []


def test_directory_doubles_only_where_it_must():
    depth, directory = grow_directory({0: 9, 1: 1, 14: 3}, 9, 4)
    assert depth == 4 and len(set(directory)) == 5 and directory == sorted(directory)
    assert grow_directory({}, 4) == (0, [0])


def test_stage_keeps_one_row_of_each_text(spark):
    rows = [*ROWS[:7], (9, "z", "x", "k"), (9, "z", "x", "k")]
    kept = drop_copies(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "KEY"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 9]


def test_stage_keeps_other_texts_of_a_dropped_id(spark):
    rows = [(5, "x", "l", "k"), (9, "x", "l", "k"), (5, "y", "l", "k"), (None, "x", "l", "k"), (None, "z", "l", "k")]
    kept = drop_copies(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == [(5, "y"), (9, "x"), (None, "z")]
