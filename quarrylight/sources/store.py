"""The chunk table on disk: Parquet versions and a manifest that names the current one."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMAT = 1


class ChunkStore:
    """A new version is written whole beside the old; then a manifest with the next number is renamed into place.

    The manifest of the greatest number counts.  No file is replaced and none
    deleted before its successor is there, so that a crash between any two
    steps leaves the old state or the new.  There is one writer at a time: of
    two, the second fails, as its manifest's name is taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._jpath = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._jpath(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"format": FORMAT, "version": 0, "applied_lsn": 0}
        rows = self.spark.read.text(f"{self.path}/manifests/{numbers[-1]:012d}.json", wholetext=True).collect()
        found = json.loads(rows[0][0])
        if found["format"] != FORMAT:
            raise ValueError(f"the store has format {found['format']}; rebuild it")
        return found

    def read(self) -> DataFrame:
        m = self.manifest()
        if not m["version"]:
            raise FileNotFoundError(f"{self.path} holds no chunks yet")
        # by its schema: a table without rows has no files to tell it
        return self.spark.read.schema(T.StructType.fromJson(json.loads(m["schema"]))).parquet(f"{self.path}/v{m['version']}")

    def write(self, chunks: DataFrame, **extra) -> int:
        """chunks may be made from the current version.  Rows are sorted by identifier, so that lookups read few row groups."""
        m = self.manifest()
        version = m["version"] + 1
        order = [c for c in ("doc_id", "chunk_id") if c in chunks.columns]
        rows = chunks.repartitionByRange("collection", *order).sortWithinPartitions("collection", *order) if order else chunks
        rows.write.mode("overwrite").partitionBy("collection").parquet(f"{self.path}/v{version}")
        self._point(m | extra | {"version": version, "schema": chunks.schema.json(), "written": int(time.time())})
        return version

    def note(self, **extra) -> None:
        """Facts in the manifest, without a new version."""
        self._point(self.manifest() | extra)

    def _point(self, manifest: dict) -> None:
        number = (self._numbers() or [0])[-1] + 1
        new, at = self._jpath(f"{self.path}/manifests/{number:012d}.{uuid.uuid4().hex}.new"), self._jpath(f"{self.path}/manifests/{number:012d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(new, at):
            raise OSError("another writer was first")

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last versions."""
        for v in range(1, self.manifest()["version"] - keep + 1):
            self._fs.delete(self._jpath(f"{self.path}/v{v}"), True)
        for n in self._numbers()[: -max(1, keep)]:
            self._fs.delete(self._jpath(f"{self.path}/manifests/{n:012d}.json"), False)
