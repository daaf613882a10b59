"""Which folders make up a store: a numbered list for each commit, written beside the earlier ones and never changed.

A commit is one rename that fails if its number is taken, so of two writers one has to look again, and a
reader sees all tables of a commit or none. Lists name folders, not rows: with folders merged now and then
(``Store.compact``) they stay short.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer took the number."""


class Files:
    """The few file operations that a store needs, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _of(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        system, where = self._of(path)
        return system.exists(where)

    def delete(self, path: str) -> None:
        system, where = self._of(path)
        system.delete(where, True)

    def names(self, path: str) -> list[str]:
        system, where = self._of(path)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def read(self, path: str) -> str:
        system, where = self._of(path)
        stream = system.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        system, where = self._of(path)
        stream = system.create(where, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, source: str, target: str) -> bool:
        """Moves a file or folder, in one step; False if the target is there."""
        system, where = self._of(source)
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        system.mkdirs(to.getParent())
        if system.exists(to):
            return False
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.conf)
        choices = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(system.makeQualified(where), system.makeQualified(to), choices)
        except Py4JJavaError as why:
            if "FileAlreadyExists" in str(why.java_exception):
                return False
            raise
        return True


EMPTY = {"version": 0, "tables": {}, "streams": {}}


class Commits:
    def __init__(self, spark: SparkSession, root: str, keep: int = 20):
        self.files, self.folder, self.keep = Files(spark), f"{root}/_commits", keep

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:012}.json"

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(self.folder) if n.endswith(".json") and not n.startswith(".")]

    def latest(self) -> dict:
        known = self.versions()
        return json.loads(self.files.read(self._path(known[-1]))) if known else json.loads(json.dumps(EMPTY))

    def at(self, version: int) -> dict:
        return json.loads(self.files.read(self._path(version)))

    def commit(self, state: dict) -> None:
        """Makes ``state`` the next version; Conflict if there is one already."""
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        self.files.write(draft, json.dumps(state, sort_keys=True))
        if not self.files.rename(draft, self._path(state["version"])):
            self.files.delete(draft)
            raise Conflict(f"version {state['version']} is there already")
        for old in self.versions()[: -self.keep]:
            self.files.delete(self._path(old))
