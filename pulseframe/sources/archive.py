"""The export archive: a zip with one large XML member, read as a stream.

Spark can't split a zip, so one task unpacks it; the member is cut there into stretches of
whole top-level elements, which are dealt out, and everything after that is parallel.
"""

from __future__ import annotations

import io
import json
import os
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER = "export.xml"
TAGS = ("Record", "Workout", "ActivitySummary", "ClinicalRecord")


def newest(folder: str) -> str | None:
    """The zip that was changed last."""
    found = [e.path for e in os.scandir(folder) if e.name.lower().endswith(".zip") and e.is_file()]
    return max(found, key=os.path.getmtime, default=None)


def member(archive: zipfile.ZipFile) -> zipfile.ZipInfo:
    """The export among the members: by its exact name, the least deep."""
    found = [m for m in archive.infolist() if not m.is_dir() and m.filename.rsplit("/", 1)[-1] == MEMBER]
    if not found:
        raise FileNotFoundError(f"no {MEMBER} in {archive.filename}")
    return min(found, key=lambda m: (m.filename.count("/"), m.filename))


def fingerprint(path: str) -> str:
    """Checksum and size of the export as the zip's directory states them: nothing is unpacked."""
    with zipfile.ZipFile(path) as archive:
        own = member(archive)
        return f"crc1:{own.CRC:08x}:{own.file_size}"


def imported(state: str, path: str) -> bool:
    """Whether the state file says that this very export is in."""
    try:
        with open(state, encoding="utf-8") as file:
            return json.load(file).get("fingerprint") == fingerprint(path)
    except (OSError, ValueError, AttributeError):
        return False


def remember(state: str, path: str) -> None:
    draft = f"{state}.{os.getpid()}"
    with open(draft, "w", encoding="utf-8") as file:
        json.dump({"archive": os.path.basename(path), "fingerprint": fingerprint(path)}, file)
    os.replace(draft, state)


def found(stream, tags=TAGS, block: int = 1 << 20):
    """For each block read: the bytes at hand, and (tag, start, end) of the whole top-level elements of these tags in them."""
    begin = re.compile(rb"<(" + "|".join(tags).encode() + rb")(?=[\s/>])")
    opening = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")
    held, at, more = b"", 0, True
    while more:
        spans = []
        while (start := begin.search(held, at)) is not None:
            tag, at, end = start[1], start.start(), None
            if head := opening.match(held, at):
                if head[0].endswith(b"/>"):
                    end = head.end()
                else:
                    close = held.find(b"</" + tag + b">", head.end())
                    end = close + len(tag) + 3 if close >= 0 else None
            if end is None:
                break
            spans.append((tag, at, end))
            at = end
        else:
            at = max(at, len(held) - 64)
        if spans:
            yield held, spans
        data = stream.read(block)
        more = bool(data)
        held, at = held[at:] + data, 0  # what is read is cut off once a block


def elements(stream, tags=TAGS, block: int = 1 << 20):
    """(tag, text) of the top-level elements of these tags; what a cut-off file holds whole is kept."""
    for held, spans in found(stream, tags, block):
        for tag, start, end in spans:
            yield tag.decode(), held[start:end].decode("utf-8", "replace")


def stretches(stream, tags=TAGS, block: int = 1 << 20):
    """The same elements as bytes from the first to the last whole one of each block, for others to take apart."""
    for held, spans in found(stream, tags, block):
        yield held[spans[0][1] : spans[-1][2]]


class ExportReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.tags = tuple(t for t in options.get("tags", "").split(",") if t) or TAGS

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        names = ["number", "xml"]
        with zipfile.ZipFile(partition.value) as archive, archive.open(member(archive)) as stream:
            for number, part in enumerate(stretches(stream, self.tags)):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.binary())], names=names)


class ExportSource(DataSource):
    """format("health_export"): (number, xml) rows of an archive, each of many whole elements; option ``tags`` limits them."""

    @classmethod
    def name(cls):
        return "health_export"

    def schema(self):
        return "number long, xml binary"

    def reader(self, schema):
        return ExportReader(self.options)


#: Bytes of the unpacked export that one task takes apart and parses, about.
TASK_BYTES = 16 << 20


def read_archive(spark: SparkSession, path: str, tags=TAGS) -> DataFrame:
    """(tag, xml) rows of an archive: one task unpacks and finds where elements end, the rest is dealt out."""
    spark.dataSource.register(ExportSource)
    with zipfile.ZipFile(path) as archive:
        tasks = 1 + member(archive).file_size // TASK_BYTES
    raw = spark.read.format("health_export").option("path", path).option("tags", ",".join(tags)).load()

    def taken_apart(batches):
        for batch in batches:
            for part in batch.column(1):
                rows = list(elements(io.BytesIO(part.as_py()), tags))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["tag", "xml"])

    return raw.repartition(tasks, "number").mapInArrow(taken_apart, "tag string, xml string")
