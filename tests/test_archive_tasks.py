"""An archive is unpacked by one task and parsed by many, once for all tables."""

import io
import zipfile

from pulseframe.sources import archive, xml


def test_stretches_hold_the_same_elements():
    text = b'<HealthData><Record type="a"/><Workout n="1"><WorkoutEvent type=">"/></Workout>' + b'<Correlation><Record type="b" value="x>y"/></Correlation>' * 30 + b'<Record type="c'
    whole = list(archive.elements(io.BytesIO(text)))
    for block in (5, 64, 300, 1 << 20):
        parts = list(archive.stretches(io.BytesIO(text), block=block))
        assert [e for part in parts for e in archive.elements(io.BytesIO(part))] == whole
    assert len(whole) == 32


def test_an_archive_is_parsed_by_many_tasks_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "TASK_BYTES", 1 << 19)
    path, day = str(tmp_path / "export.zip"), '2024-01-01 08:00:00 +0000'
    with zipfile.ZipFile(path, "w") as file:
        rows = "".join(f'<Record type="HKQuantityTypeIdentifierHeartRate" sourceName="W" unit="count/min" value="{i}" startDate="{day}" endDate="{day}"/>\n' for i in range(20_000))
        file.writestr("apple_export/export.xml", f"<HealthData>{rows}</HealthData>")
    read = archive.read_archive(spark, path)
    assert read.count() == 20_000 and read.rdd.getNumPartitions() > 4
    frames = xml.export_frames(spark, path, folder=str(tmp_path / "kept"))
    archive.os.remove(path)  # what follows reads the kept elements
    assert frames["records"].count() == 20_000 and frames["records"].agg({"value": "sum"}).first()[0] == sum(range(20_000)) and frames["workouts"].count() == 0
