"""WARC archives of pages, and an index of their captures merged from sorted runs.

Method. Every task writes its pages as WARC 1.1 records, one gzip member each, and
leaves the captures of each archive as a run sorted by URL key, time and page. The
runs are merged externally: owner tasks take ranges of (URL key, time, page), and in
each a loser tree merges the k sorted runs, one comparison a level for each capture.
Together the ranges are one globally ordered index, in which a URL's captures
follow one another in time. Since the range key ends in the page, a URL with very
many captures is spread over ranges like any other.

Equal payloads of MIN_REVISIT bytes or more are stored once: the smallest page_id is
the response, the others are revisit records (identical-payload-digest) that carry
the HTTP header and refer to it. Archives go to the shared folder under names that
depend on the task alone, and appear there by a rename, so a task that is run again
replaces its own files with equal ones.

Semantics. A null html is an empty payload; a null url has the key "" and URI "null:".
Rows that repeat a page_id are captures of their own. A null page_id is above all
others: such a row is a revisit if its payload has a response. Pages carry no time;
the default capture time is EPOCH plus page_id seconds, modulo SPAN of them so that any id gives a
date of this era (0 for a null id). An empty table gives an empty archive and index. Extra columns are ignored.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table, texts_of, utf8

MIN_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Captures that one merge task takes.
MERGE_ROWS = 100_000
#: Digests (about 100 bytes each) that may be broadcast.
BROADCAST_DIGESTS = 200_000
EPOCH = 1_577_836_800
SPAN = 1 << 32
#: Tasks that read archives back, at most; one takes several archives beyond that.
READERS = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = T.StructType(
    [
        T.StructField(n, t())
        for n, t in (
            ("url_key", T.StringType), ("captured", T.LongType), ("page_id", T.LongType), ("record_type", T.StringType),
            ("digest", T.StringType), ("archive", T.StringType), ("offset", T.LongType), ("length", T.LongType), ("seq", T.LongType),
        )
    ]
)
RECORD = T.StructType(
    [
        T.StructField(n, t())
        for n, t in (
            ("archive", T.StringType), ("offset", T.LongType), ("page_id", T.LongType), ("url", T.StringType), ("payload", T.BinaryType),
            ("payload_bytes", T.LongType), ("payload_digest", T.StringType), ("record_type", T.StringType), ("refers_to", T.LongType),
        )
    ]
)


def url_key(url: str | None) -> str:
    """Host labels from the top, then path and query: com,example,www)/path?query."""
    if not url:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).split("#", 1)[0]
    raw = re.match(r"[^/?]*", rest)[0]
    host = raw.rpartition("@")[2].partition(":")[0].lower().rstrip(".")
    return ",".join(reversed(host.split("."))) + ")" + (rest[len(raw) :] or "/")


def record(kind: str, page, url: str | None, captured: int, digest: str, payload: bytes, refers_to) -> bytes:
    when = datetime.datetime.fromtimestamp(captured, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page is None else page}>",
        f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127)))) if url is not None else 'null:'}",
        f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        body += payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def packed(raw: bytes) -> bytes:
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


class LoserTree:
    """Merges sorted iterators of tuples; inner nodes hold the losers, so a step replays one path."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.tree = [-1] * max(1, k)
        for leaf in range(k):
            self._enter(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _enter(self, leaf: int) -> None:
        """First games: a node waits for its second player."""
        node, player = (leaf + len(self.runs)) // 2, leaf
        while node:
            if self.tree[node] < 0:
                self.tree[node] = player
                return
            if self._before(self.tree[node], player):
                self.tree[node], player = player, self.tree[node]
            node //= 2
        self.tree[0] = player

    def __iter__(self):
        k = len(self.runs)
        while k and (won := self.heads[self.tree[0]]) is not None:
            yield won
            player = self.tree[0]
            self.heads[player] = next(self.runs[player], None)
            node = (player + k) // 2
            while node:
                if self._before(self.tree[node], player):
                    self.tree[node], player = player, self.tree[node]
                node //= 2
            self.tree[0] = player


class Archives:
    def __init__(self, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"):
        spark = pages.sparkSession
        self.scratch = Scratch(spark, "warc")
        source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("payload"))
        self.captures = self.scratch.keep(self._written(self._placed(source)), "runs")
        self.index = self.scratch.keep(self._merged(), "index")

    def _placed(self, source: DataFrame) -> DataFrame:
        """The pages with digest and the page_id of the response that stands for them (null: themselves)."""
        source = source.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
        groups = (
            source.filter(F.octet_length("payload") >= MIN_REVISIT)
            .groupBy("digest")
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
            .select("digest", "first")
        )
        groups = self.scratch.keep(groups, "groups")
        side = F.broadcast(groups) if groups.count() <= BROADCAST_DIGESTS else groups
        joined = source.join(side, "digest", "left")
        return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")

    def _written(self, placed: DataFrame) -> DataFrame:
        root = self.scratch.path("archives")

        def run(batches):
            store, folder = fs.FileSystem.from_uri(root)
            store.create_dir(folder, recursive=True)
            task = TaskContext.get()
            rows, out, size, at = [], None, 0, 0

            def close():
                nonlocal out, rows, size, at
                out.close()
                store.move(f"{folder}/{draft}", f"{folder}/{name}")
                rows.sort(key=lambda r: (r[0], r[1], r[2] is None, r[2], r[6]) if r[2] is not None else (r[0], r[1], True, 0, r[6]))
                columns = list(zip(*(r + (i,) for i, r in enumerate(rows)), strict=True))
                out, rows, size, at = None, [], 0, at + 1
                return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, ARROW_CAPTURE, strict=True)], names=CAPTURE.names)

            for batch in batches:
                fields = batch.to_pydict()
                for page, url, payload, digest, first in zip(fields["page_id"], fields["url"], fields["payload"], fields["digest"], fields["refers_to"], strict=True):
                    if out is None:
                        name = f"{task.partitionId():06d}-{at:04d}.warc.gz"
                        draft = f".{name}.{task.taskAttemptId()}"
                        out = store.open_output_stream(f"{folder}/{draft}", compression=None)
                        info = b"software: pulseframe\r\nformat: WARC File Format 1.1\r\n"
                        data = packed(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:%s>\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (name.encode(), len(info), info))
                        out.write(data)
                        size += len(data)
                    kind = "response" if first is None else "revisit"
                    captured = EPOCH + (page or 0) % SPAN
                    data = packed(record(kind, page, url, captured, digest, utf8(payload), first))
                    out.write(data)
                    rows.append((url_key(url), captured, page, kind, digest, name, size, len(data)))
                    size += len(data)
                    if size >= ARCHIVE_BYTES:
                        yield close()
            if out is not None:
                yield close()

        return placed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, CAPTURE)

    def _merged(self) -> DataFrame:
        """All captures by URL key, time and page: ``part`` and ``position`` number them in that order."""
        spark = self.captures.sparkSession
        rows = self.captures.count()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / MERGE_ROWS))
        keys = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_last(), F.col("archive"), F.col("seq")]
        ranged = self.captures.repartitionByRange(parts, *keys).sortWithinPartitions("archive", "seq")
        schema = T.StructType([*CAPTURE.fields, T.StructField("part", T.LongType()), T.StructField("position", T.LongType())])

        def run(batches):
            runs: dict[str, list] = {}
            for batch in batches:
                for r in zip(*batch.to_pydict().values(), strict=True):
                    runs.setdefault(r[5], []).append(((r[0], r[1], r[2] is None, r[2] or 0, r[5], r[8]), r))
            part = TaskContext.get().partitionId()
            merged, at = LoserTree(runs.values()), 0
            held = []
            for _, r in merged:
                held.append((*r, part, at))
                at += 1
                if len(held) == 10_000:
                    yield rows_to_batch(held)
                    held = []
            if held:
                yield rows_to_batch(held)

        def rows_to_batch(held):
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, [*ARROW_CAPTURE, pa.int64(), pa.int64()], strict=True)], names=schema.names)

        return ranged.mapInArrow(run, schema)

    def numbered(self) -> DataFrame:
        """The index with ``index_no``, the place in the global order; one count for each merge task is collected."""
        counts = sorted((r["part"], r["count"]) for r in self.index.groupBy("part").count().collect())
        before, starts = 0, []
        for part, n in counts:
            starts.append((part, before))
            before += n
        lookup = self.index.sparkSession.createDataFrame(starts, "part long, before long")
        return self.index.join(F.broadcast(lookup), "part").withColumn("index_no", F.col("before") + F.col("position")).drop("before")

    def records(self) -> DataFrame:
        """All records read back from the archives; a revisit's payload is null, its size and digest are the response's."""
        root = self.scratch.path("archives")
        # dealt by number: a deal by name would be merged with distinct's own, and its partitions with each other
        files = self.scratch.keep(self.captures.select("archive").distinct(), "files")
        files = files.repartition(max(1, min(files.count(), READERS)))

        def run(batches):
            store, folder = fs.FileSystem.from_uri(root)
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    held, size = [], 0
                    with store.open_input_stream(f"{folder}/{name}", compression=None) as raw:
                        for offset, one in members(raw):
                            if (row := parsed(one)) is not None:
                                held.append((name, offset, *row))
                                size += len(one)
                            if size > 8 << 20:
                                yield as_batch(held)
                                held, size = [], 0
                    if held:
                        yield as_batch(held)

        def as_batch(held):
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, ARROW_RECORD, strict=True)], names=RECORD.names)

        return files.mapInArrow(run, RECORD)


ARROW_CAPTURE = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
ARROW_RECORD = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def members(raw):
    """(offset, bytes) of each gzip member of a stream."""
    begin = read = 0
    undo, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = raw.read(1 << 20)
            if not data:
                break
            read += len(data)
        parts.append(undo.decompress(data))
        data = undo.unused_data
        if undo.eof:
            yield begin, b"".join(parts)
            begin = read - len(data)
            undo, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("an archive ends within a record")


def parsed(raw: bytes):
    """page_id, url, payload, its size and digest, record type, page referred to; None for a warcinfo record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "warcinfo":
        return None
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda name: None if (x := fields[name][10:-1]) == "null" else int(x)
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: payload and header disagree")
        return page("WARC-Record-ID"), fields["WARC-Target-URI"], payload, size, digest, kind, None
    return page("WARC-Record-ID"), fields["WARC-Target-URI"], None, size, digest, kind, page("WARC-Refers-To")


def op6_warc(spark, sf_dir):
    archives = Archives(table(spark, sf_dir, "pages"))
    read = archives.records().drop("payload", "url")
    history = archives.numbered().select("archive", "offset", "url_key", "captured", "index_no")
    # both sides grow with the pages
    return read.hint("merge").join(history, ["archive", "offset"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "index_no"
    )


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
     k AS (SELECT *, strlen(payload) AS n, sha256(payload) AS digest,
                  regexp_replace(split_part(coalesce(url, ''), '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM p),
     h AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS raw FROM k),
     u AS (SELECT *, CASE WHEN coalesce(url, '') = '' THEN '' ELSE
                  array_to_string(list_reverse(string_split(rtrim(lower(split_part(split_part(raw, '@', -1), ':', 1)), '.'), '.')), ',')
                  || ')' || CASE WHEN length(rest) = length(raw) THEN '/' ELSE rest[length(raw) + 1:] END END AS url_key,
                  CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       url_key, 1577836800 + ((page_id % 4294967296) + 4294967296) % 4294967296 AS captured,
       row_number() OVER (ORDER BY url_key, ((page_id % 4294967296) + 4294967296) % 4294967296, page_id) - 1 AS index_no
FROM u
"""
