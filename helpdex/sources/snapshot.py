"""The stored index: versioned Parquet folders of documents and chunks behind one manifest.

A change writes a whole new snapshot and then renames its manifest into place, so readers see both tables of the old
snapshot or both of the new one, and a failed run leaves the old one as it was. Paths may be on any Hadoop file system.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = 1
DOCS = "path string, hash string, title string, url string"
CHUNKS = "path string, ord int, kind string, text string, vec array<float>"


@dataclass(frozen=True)
class Manifest:
    schema: int
    snapshot: int
    fingerprint: str
    docs: int
    chunks: int


def fingerprint(**settings: object) -> str:
    """A digest of the settings that an index depends on (model, dims, prefixes, chunk size)."""
    return sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> Manifest | None:
        """The current manifest; None without an index or with one of another schema version."""
        at = self._path(f"{self.base}/manifest.json")
        if not self._fs.exists(at):
            return None
        values = json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.base}/manifest.json").collect()))
        found = Manifest(**values)
        return found if found.schema == SCHEMA_VERSION else None

    def read(self) -> tuple[DataFrame, DataFrame]:
        """Documents and chunks of one snapshot; empty frames without an index."""
        m = self.manifest()
        if m is None:
            return self.spark.createDataFrame([], DOCS), self.spark.createDataFrame([], CHUNKS)
        return tuple(self.spark.read.schema(s).parquet(f"{self.base}/snapshot={m.snapshot}/{name}") for name, s in (("docs", DOCS), ("chunks", CHUNKS)))

    def write(self, docs: DataFrame, chunks: DataFrame, fingerprint_: str) -> Manifest:
        """Write a new snapshot of both tables and make it the current one."""
        old = self.manifest()
        number = old.snapshot + 1 if old else 1
        folder = f"{self.base}/snapshot={number}"
        docs.write.mode("overwrite").parquet(f"{folder}/docs")
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
        counts = [self.spark.read.parquet(f"{folder}/{t}").count() for t in ("docs", "chunks")]
        new = Manifest(SCHEMA_VERSION, number, fingerprint_, *counts)
        fresh, current = self._path(f"{self.base}/manifest.new"), self._path(f"{self.base}/manifest.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        self._fs.delete(current, False)
        self._fs.rename(fresh, current)
        return new
