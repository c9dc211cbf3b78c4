"""Stored objects by URI, on any file system that Hadoop knows."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SCHEMES = ("s3", "minio", "local")
_FORM = r"^(s3|minio|local)://([A-Za-z0-9][A-Za-z0-9._-]*)/(.+)$"


def parse_uri(uri: Column) -> Column:
    """struct(scheme, bucket, key), or null: schemes are s3, minio and local; a key has no empty, "." or ".." part and no backslash."""
    key = F.regexp_extract(uri, _FORM, 3)
    parts = F.split(key, "/")
    clean = ~F.exists(parts, lambda p: p.isin("", ".", "..")) & ~key.contains("\\")
    return F.when(uri.rlike(_FORM) & clean, F.struct(F.regexp_extract(uri, _FORM, 1).alias("scheme"), F.regexp_extract(uri, _FORM, 2).alias("bucket"), key.alias("key")))


def allowed(uri: Column, bucket: str, tenant: str | None = None) -> Column:
    """Whether an object may be referred to: of this bucket, and under the tenant's prefix if the caller has one."""
    at = parse_uri(uri)
    ok = at["bucket"] == bucket
    if tenant is not None:
        ok = ok & at["key"].startswith(tenant + "/")
    return F.coalesce(ok, F.lit(False))


class ObjectStore:
    """put, get, exists and delete below a root folder; keys can't leave it."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._copy = spark._jvm.org.apache.hadoop.io.IOUtils

    def _at(self, key: str):
        if not key or "\\" in key or any(p in ("", ".", "..") for p in key.split("/")):
            raise ValueError(f"not a key: {key!r}")
        return self._path(f"{self.root}/{key}")

    def put(self, key: str, data: bytes) -> None:
        out = self._fs.create(self._at(key), True)
        out.write(bytearray(data))
        out.close()

    def exists(self, key: str) -> bool:
        return self._fs.exists(self._at(key))

    def get(self, key: str, most: int = 64 << 20) -> bytes | None:
        """None if there is none; ValueError if it has more than ``most`` bytes."""
        if not self.exists(key):
            return None
        n = self._fs.getFileStatus(self._at(key)).getLen()
        if n > most:
            raise ValueError(f"{key} has {n} bytes")
        stream = self._fs.open(self._at(key))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def delete(self, key: str) -> bool:
        return self._fs.delete(self._at(key), False)
