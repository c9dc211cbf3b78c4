"""What the corpus operators share about running on a cluster."""

from __future__ import annotations

import tempfile

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of the session's spark.checkpoint.dir.

    Only where none is set, as in local tests, a temporary folder is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts: sizes the shuffles, never the result."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def partitions(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about ``each`` units; at least what keeps the session's cores busy."""
    return int(min(1 << 15, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed value: byte planes of each, high planes together."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    kinds = [np.dtype(d) for d in dtypes]
    n = len(raw) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        part = raw[at : at + n * k.itemsize].reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(part.T).view(k).reshape(n))
        at += n * k.itemsize
    return out
