"""Versioned tables: Parquet directories, and a small manifest that names the current one.

A write makes a new directory and then replaces the manifest, if it still is at the version that the writer read; readers
see one version or the other. Counters in the manifest stand for the statistics of a database: rows live and superseded, writes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer was faster, or holds the lock."""


class Store:
    """The tables below one path, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- manifests --
    def _at(self, *parts: str):
        return self._path("/".join((self.root, *parts)))

    def _read(self, path):
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, path, text: str, overwrite: bool) -> None:
        stream = self._fs.create(path, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def manifest(self, table: str) -> dict:
        path = self._at(table, "manifest.json")
        return json.loads(self._read(path)) if self._fs.exists(path) else {"version": 0, "live": 0, "dead": 0, "writes": 0, "dir": None}

    def fingerprint(self, table: str) -> int:
        """Changes with every write."""
        return self.manifest(table)["version"]

    def dead_pct(self, table: str) -> float:
        m = self.manifest(table)
        return 100.0 * m["dead"] / (m["dead"] + m["live"]) if m["dead"] + m["live"] else 0.0

    # -- tables --
    def read(self, table: str) -> DataFrame:
        m = self.manifest(table)
        if not m["dir"]:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.root}/{table}/{m['dir']}")

    def write(self, table: str, df: DataFrame, superseded: int | None = None, expect: int | None = None, before_swap: Callable[[], None] | None = None) -> dict:
        """Make ``df`` the current version. ``superseded``: old row versions that it leaves behind (all, if not told)."""
        m = self.manifest(table)
        if expect is not None and expect != m["version"]:
            raise Conflict(f"{table} is at version {m['version']}, not {expect}")
        name = f"v{m['version'] + 1}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{table}/{name}")
        if before_swap:
            before_swap()
        live = self.spark.read.parquet(f"{self.root}/{table}/{name}").count()
        new = {"version": m["version"] + 1, "live": live, "dead": m["dead"] + (m["live"] if superseded is None else superseded), "writes": m["writes"] + 1, "dir": name}
        with self.lock(f"{table}.swap"):
            if self.manifest(table)["version"] != m["version"]:
                raise Conflict(f"{table} changed meanwhile")
            self._write(self._at(table, "manifest.json"), json.dumps(new), True)
        return new

    def append(self, table: str, df: DataFrame) -> dict:
        m = self.manifest(table)
        return self.write(table, self.read(table).unionByName(df) if m["dir"] else df, superseded=0, expect=m["version"])

    def reload(self, table: str, df: DataFrame) -> dict:
        """Truncate and load."""
        out = self.write(table, df)
        return self.compact(table, out)

    def seed(self, table: str, df: DataFrame) -> bool:
        """Load only if the table is empty."""
        if self.manifest(table)["live"]:
            return False
        self.write(table, df)
        return True

    def compact(self, table: str, m: dict | None = None) -> dict:
        """Forget superseded rows and drop old versions."""
        m = (m or self.manifest(table)) | {"dead": 0}
        for f in self._fs.listStatus(self._at(table)):
            if f.isDirectory() and f.getPath().getName() not in (m["dir"],):
                self._fs.delete(f.getPath(), True)
        self._write(self._at(table, "manifest.json"), json.dumps(m), True)
        return m

    def clone(self, table: str, to: Store) -> None:
        """Backup, restore or sandbox: the current version, copied to another store."""
        to.write(table, self.read(table))

    def swap_in(self, table: str, make: Callable[[], DataFrame]) -> dict:
        """Rebuild a derived table and swap it in; readers keep the old one until then."""
        return self.write(table, make())

    # -- locks --
    class _Lock:
        def __init__(self, store: Store, path):
            self.store, self.path = store, path

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.store._fs.delete(self.path, False)

    def lock(self, name: str) -> _Lock:
        """A lock file; raises Conflict if someone holds it."""
        path = self._at("locks", name)
        try:
            self._write(path, json.dumps({"pid": os.getpid()}), False)
        except Exception as e:
            if self._fs.exists(path):
                raise Conflict(f"{name} is locked") from e
            raise
        return Store._Lock(self, path)
