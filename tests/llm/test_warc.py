import hashlib
import random

from pulseframe.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"


def pages(seed=3):
    draw = random.Random(seed)
    bodies = ["x" * 99, "y" * 100, "é" * 60, "<p>\r\n\r\nWARC/1.1\r\n</p>" * 20, "z" * 300_000, "", None]
    rows = [(i, f"http://{draw.choice(['a', 'b.c'])}.example.org/{draw.randrange(9)}#t", draw.choice(bodies) if draw.random() < 0.6 else f"page {i} " * 30, "d") for i in range(120)]
    return rows + [(500, None, "y" * 100, "d"), (501, "odd\r\nurl é", "y" * 100, None), (7, rows[7][1], rows[7][2], "d")]


def expected(rows):
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        first = min(p for p, _, h, _ in rows if (h or "") == (html or ""))
        revisit = len(data) >= 100 and first != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = pages()
    archives = W.Archives(spark.createDataFrame(rows, SCHEMA).repartition(5))
    read = archives.records().collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=repr) == expected(rows)
    html = {p: (h or "").encode() for p, _, h, _ in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in read if r.record_type == "response")
    order = [(r.url_key, r.captured, r.page_id) for r in archives.numbered().orderBy("index_no").collect()]
    assert order == sorted((W.url_key(u), W.EPOCH + p, p) for p, u, _, _ in rows)
    found = {(r.archive, r.offset) for r in read}
    assert found == {(r.archive, r.offset) for r in archives.index.collect()}


def test_null_ids_and_empty_table(spark):
    assert W.Archives(spark.createDataFrame([], SCHEMA)).records().collect() == []
    body = "w" * 200
    archives = W.Archives(spark.createDataFrame([(None, "http://a/", body, None), (3, "http://a/", body, None)], SCHEMA))
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in archives.records().collect()), key=repr) == [(3, "response", None), (None, "revisit", 3)]
    assert [r.page_id for r in archives.numbered().orderBy("index_no").collect()] == [None, 3]


def test_ids_of_any_size_have_dates(spark):
    ids = [10**15, -(10**15), 2**62, 0, -1]
    archives = W.Archives(spark.createDataFrame([(i, "http://a/", "v" * 200, None) for i in ids], SCHEMA))
    read = archives.records().collect()
    assert {r.page_id for r in read} == set(ids) and {r.refers_to for r in read} == {None, min(ids)}
    order = [(r.captured, r.page_id) for r in archives.numbered().orderBy("index_no").collect()]
    assert order == sorted((W.EPOCH + i % W.SPAN, i) for i in ids)


def test_archives_are_read_by_tasks_of_their_own(spark):
    archives = W.Archives(spark.createDataFrame(pages(), SCHEMA).repartition(6))
    assert archives.records().rdd.getNumPartitions() == archives.captures.select("archive").distinct().count() > 1


def test_keys_and_members():
    assert W.url_key("https://u@WWW.Example.com:80/a/B?q=1#x") == "com,example,www)/a/B?q=1"
    assert W.url_key("http://example.com") == "com,example)/" and W.url_key(None) == ""
    import io

    raw = [b"one", b"", b"three" * 500_000]
    stream = b"".join(W.packed(r) for r in raw)
    found = list(W.members(io.BytesIO(stream)))
    assert [f for _, f in found] == raw and found[0][0] == 0 and found[1][0] == len(W.packed(b"one"))


def test_loser_tree_merges():
    draw = random.Random(1)
    for k in (0, 1, 2, 5, 8):
        runs = [sorted((draw.randrange(50),) for _ in range(draw.randrange(20))) for _ in range(k)]
        assert list(W.LoserTree(runs)) == sorted(x for r in runs for x in r)
