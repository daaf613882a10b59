"""A batch of one gzip file is read by one task; the work on its lines is dealt out."""

import gzip

from pulseframe.sources import ndjson
from pulseframe.sources.sink import Store
from pulseframe.streaming import delta


def test_lines_of_one_file_are_dealt_out(spark, tmp_path, monkeypatch):
    path = tmp_path / "lines.json.gz"
    with gzip.open(path, "wt") as file:
        file.write("".join(f'{{"kind": "riddle{i}"}}\n' for i in range(100)))
    seen, frames = [], delta.delta_frames
    monkeypatch.setattr(delta, "delta_frames", lambda lines: seen.append(lines.rdd.getNumPartitions()) or frames(lines))
    lines = ndjson.read_lines(spark, str(path))
    assert lines.rdd.getNumPartitions() == 1
    delta.import_batch(Store(spark, str(tmp_path / "store")), lines, 0)
    assert seen[0] > 1
