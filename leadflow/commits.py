"""Commits on shared storage: data first, then one small file that makes it visible.

A commit is a JSON file that is created under a name that must not exist yet. Readers know only what commits name, so what a
killed writer leaves behind is never read, and of two writers of one name the second fails. Creating a file only if
it is new is what HDFS, local disks and object stores with conditional writes offer.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession


STALE_SECONDS = 600


class CommitConflict(RuntimeError):
    """Another writer has made this commit."""


class Commits:
    """The commits of a folder, by name."""

    def __init__(self, spark: SparkSession, path: str):
        context = spark.sparkContext
        self._jvm, self.path = context._jvm, path
        self._system = context._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.json")

    def names(self) -> list[str]:
        """Names of all commits, in order; a file that is still empty is no commit yet."""
        folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self._system.exists(folder):
            return []
        found = [(f.getPath().getName(), f.getLen()) for f in self._system.listStatus(folder)]
        return sorted(n[: -len(".json")] for n, size in found if n.endswith(".json") and not n.startswith(("_", ".")) and size)

    def read(self, name: str) -> dict:
        stream = self._system.open(self._file(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def add(self, name: str, content: dict) -> None:
        """Make the commit, or raise ``CommitConflict`` if there is one of that name.

        An empty file is a commit that its writer is making, or was when it was ended; after ``STALE_SECONDS`` it is taken for the latter."""
        file = self._file(name)
        self._system.mkdirs(file.getParent())
        if self._system.exists(file):
            status = self._system.getFileStatus(file)
            if not status.getLen() and time.time() - status.getModificationTime() / 1000 > STALE_SECONDS:
                self._system.delete(file, False)
        try:
            stream = self._system.create(file, False)
        except Exception as exc:
            if self._system.exists(file):
                raise CommitConflict(f"{self.path}/{name} has been committed by another writer") from exc
            raise
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()

    def folders(self, path: str) -> list[str]:
        folder = self._jvm.org.apache.hadoop.fs.Path(path)
        return sorted(f.getPath().getName() for f in self._system.listStatus(folder) if f.isDirectory()) if self._system.exists(folder) else []

    def remove(self, path: str) -> None:
        self._system.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)
