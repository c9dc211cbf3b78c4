"""Bytes, addresses and images on columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that a browser may show in place; all others are downloads.
SHOWN = ("image/png", "image/jpeg", "image/gif", "image/webp", "audio/mpeg", "audio/wav", "video/mp4", "application/pdf")
_MAGIC = (("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("255044462D", "application/pdf"), ("494433", "audio/mpeg"))


def percent_encode(text: Column) -> Column:
    """UTF-8 bytes other than letters, digits and -._~ as %XX."""
    out = F.url_encode(text)
    for plain, coded in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def data_bytes(text: Column) -> Column:
    """The bytes of base64 text, with or without a data URL's head; null if it is no base64."""
    return F.try_to_binary(F.substring_index(F.trim(text), ",", -1), F.lit("base64"))


def is_identifier(name: Column) -> Column:
    """Whether SQL can have it as a name without quotes: ASCII letters, digits and _, no digit first, 63 at most."""
    return F.coalesce(name.rlike("^[A-Za-z_][A-Za-z0-9_]{0,62}$"), F.lit(False))


def codes_u8(vector: Column) -> Column:
    """Components of a unit vector as whole numbers from 0 to 255."""
    return F.transform(vector, lambda x: F.least(F.greatest(F.round((x.cast("double") + 1.0) * 127.5), F.lit(0.0)), F.lit(255.0)).cast("int"))


def sniff(data: Column) -> Column:
    """The media type that the first bytes tell, or application/octet-stream."""
    head = F.hex(F.substring(data, 1, 16))
    kind = None
    for magic, name in _MAGIC:
        kind = F.when(head.startswith(magic), name) if kind is None else kind.when(head.startswith(magic), name)
    riff = head.startswith("52494646")
    for at, magic, name in ((17, "57454250", "image/webp"), (17, "57415645", "audio/wav")):
        kind = kind.when(riff & (F.substring(head, at, 8) == magic), name)
    return kind.when(F.substring(head, 9, 8) == "66747970", "video/mp4").otherwise("application/octet-stream")


def byte_range(data: Column, header: Column) -> Column:
    """struct(status, start, stop, total, body) of an HTTP range: bytes=A-B, A- or -N.

    200 with all bytes without a header or with one of another form; 206 with
    the part (stop is its last byte); 416 without a body if it begins past the
    end or is empty.
    """
    total = F.octet_length(data).cast("long")
    form = "^bytes=([0-9]{0,18})-([0-9]{0,18})$"
    first, last = (F.regexp_extract(F.trim(header), form, k).try_cast("long") for k in (1, 2))
    asked = F.coalesce(F.trim(header).rlike(form), F.lit(False)) & (first.isNotNull() | last.isNotNull())
    start = F.when(~asked, 0).when(first.isNull(), F.greatest(total - last, F.lit(0))).otherwise(first)
    stop = F.when(~asked | first.isNull() | last.isNull(), total - 1).otherwise(F.least(last, total - 1))
    bad = asked & ((start >= total) | (start > stop))
    status = F.when(bad, 416).when(asked, 206).otherwise(200)
    body = F.when(~bad, F.substring(data, (start + 1).cast("int"), (stop - start + 1).cast("int")))
    return F.struct(status.alias("status"), F.when(~bad, start).alias("start"), F.when(~bad, stop).alias("stop"), total.alias("total"), body.alias("body"))


def image_embedding(data: Column, dim: int) -> Column:
    """Each run of four bytes adds +1 or -1 at a hashed place; then unit length.  Empty and null images are zero."""

    def one(raw: bytes | None) -> np.ndarray:
        out = np.zeros(dim)
        b = np.frombuffer(raw or b"", np.uint8).astype(np.uint64)
        n = min(4, len(b))
        if n:
            x = np.full(len(b) - n + 1, n, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(n):
                    x = x * np.uint64(0x100000001B3) + b[k : len(b) - n + 1 + k]
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            np.add.at(out, ((x >> np.uint64(16)) % np.uint64(dim)).astype(np.int64), 1.0 - 2.0 * (x >> np.uint64(63)).astype(float))
        size = np.sqrt((out * out).sum())
        return (out / size if size else out).astype(np.float32)

    @F.pandas_udf("array<float>")
    def embed(rows: pd.Series) -> pd.Series:
        return pd.Series([one(r) for r in rows])

    return embed(data)
