"""A full import of the newest archive: one at a time, and not again if nothing has changed."""

from __future__ import annotations

import contextlib
import fcntl
import os
import time
import uuid

from . import archive, xml
from .sink import Store


@contextlib.contextmanager
def only_one(path: str, patience: float = 120.0):
    """Holds a lock file; TimeoutError if another import doesn't end in time."""
    with open(path, "w", encoding="utf-8") as file:
        limit = time.monotonic() + patience
        while True:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() > limit:
                    raise TimeoutError(f"another import holds {path}") from None
                time.sleep(0.5)
        try:
            yield
        finally:
            fcntl.flock(file, fcntl.LOCK_UN)


def reload(store: Store, target: str, state: str, force: bool = False, workouts_only: bool = False, subject: str = "") -> dict:
    """Imports ``target`` (an archive, or the newest one in a folder); rows added by table.

    An import that fails leaves what it added, isn't remembered, and is repeated next time.
    """
    path = archive.newest(target) if os.path.isdir(target) else target
    if path is None:
        return {"state": "no archive", "added": {}}
    with only_one(f"{state}.lock"):
        if not force and not workouts_only and archive.imported(state, path):
            return {"state": "already imported", "archive": path, "added": {}}
        folder = store.path(f"_parsed/elements-{uuid.uuid4().hex}")
        try:
            frames = (xml.workout_frames if workouts_only else xml.export_frames)(store.spark, path, folder=folder)
            added = store.ingest(frames, os.path.basename(path), subject)
        finally:
            store.files.delete(folder)
        if not workouts_only:
            archive.remember(state, path)
    return {"state": "imported", "archive": path, "added": added}
