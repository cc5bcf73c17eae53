"""The stored graph: one folder of Parquet tables for each version, and a manifest that names the current one.

A batch writes a whole new version and then replaces the manifest, so readers see either state and a failed batch leaves
the old one. Where the store is on a cluster, root is a path of its shared file system.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from quillgraph.model import ANALYZER_VERSION, SCHEMA_VERSION, Graph

TABLES = ("files", "symbols", "relationships", "unresolved")


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read_text(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Written beside its place and then renamed into it."""
        tmp = self._path(f"{self.root}/.{name}.{time.time_ns()}")
        stream = self._fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(self._fs.makeQualified(tmp), self._fs.makeQualified(self._path(f"{self.root}/{name}")), options)

    def manifest(self) -> dict:
        text = self._read_text("manifest.json")
        return json.loads(text) if text else {"version": 0, "pending_files": 0, "last_verified_at": None, "schema_version": SCHEMA_VERSION, "analyzer_version": None}

    def set_pending(self, n: int) -> None:
        self._write_text("manifest.json", json.dumps(self.manifest() | {"pending_files": n}))

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Writes a version, makes it the current one with nothing pending, and drops versions older than the last `keep`."""
        now = self.manifest()
        version = now["version"] + 1
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        self._write_text("manifest.json", json.dumps(now | {"version": version, "pending_files": 0, "last_verified_at": str(int(time.time())), "schema_version": SCHEMA_VERSION, "analyzer_version": ANALYZER_VERSION}))
        old = self._path(f"{self.root}/v{version - self.keep}")
        if version > self.keep and self._fs.exists(old):
            self._fs.delete(old, True)
        return version

    def tables(self) -> dict[str, DataFrame] | None:
        version = self.manifest()["version"]
        return {n: self.spark.read.parquet(f"{self.root}/v{version}/{n}") for n in TABLES} if version else None

    def graph(self) -> Graph | None:
        t = self.tables()
        if t is None:
            return None
        m = self.manifest()
        state = self.spark.createDataFrame([("prj", m["pending_files"], m["last_verified_at"])], "project_id string, pending_files long, last_verified_at string")
        return Graph(t["files"], t["symbols"], t["relationships"], t["unresolved"], state)
