"""Versioned manifests: which folders of a stored table are live.

A table that changes by whole folders keeps a small JSON text per version.  A version is
written beside the others and then renamed into place, after all its folders are complete,
so readers see the table before a change or after it, never between.  Versions are
numbered by the micro-batch that made them; a replayed batch starts from the version
before its own and writes the same one again.

Only folder names and row counts are in a manifest.  Files are reached through the Hadoop
FileSystem of the path, so any store that Spark reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

FOLDER = "_manifest"


class Files:
    """The few file operations that Spark's readers and writers do not cover."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole text under its name at once: written aside, then renamed."""
        aside, place = self._path(f"{self.root}/{name}.tmp"), self._path(f"{self.root}/{name}")
        stream = self._fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(place, False)
        if not self._fs.rename(aside, place):
            raise OSError(f"could not rename to {place}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.files = Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(FOLDER) if n.endswith(".json"))

    def load(self, before: int | None = None) -> tuple[int | None, dict]:
        """Number and content of the last version (below ``before``); (None, {}) without one."""
        found = [v for v in self.versions() if before is None or v < before]
        return (found[-1], json.loads(self.files.read(f"{FOLDER}/{found[-1]}.json"))) if found else (None, {})

    def commit(self, version: int, content: dict, folders) -> None:
        """Switch to ``content``.  ``folders`` gives the folders that a content names; those that only
        versions older than the one before name are deleted, with these versions."""
        self.files.write(f"{FOLDER}/{version}.json", json.dumps(content, separators=(",", ":")))
        *old, _ = [v for v in self.versions() if v < version] or [None]
        live = {f for v in self.versions() if v not in old for f in folders(json.loads(self.files.read(f"{FOLDER}/{v}.json")))}
        for v in old:
            for folder in set(folders(json.loads(self.files.read(f"{FOLDER}/{v}.json")))) - live:
                self.files.delete(folder)
            self.files.delete(f"{FOLDER}/{v}.json")
