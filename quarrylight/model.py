"""The chunk table and its identifiers."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("heading", "paragraph", "table", "code", "list_item", "image", "audio", "video")
MODALITIES = ("text", "image", "audio", "video")
VECTOR_STATES = ("pending", "embedded", "text_fallback", "missing_bytes", "asset_missing", "error")
#: Limits of a chunk's metadata: bytes, keys, depth.
METADATA_BYTES, METADATA_KEYS, METADATA_DEPTH = 64 * 1024, 256, 16

_BOX = "struct<x0:float,y0:float,x1:float,y1:float>"
_ASSET = f"struct<kind:string,uri:string,page:int,bbox:{_BOX}>"
MEDIA = f"struct<asset:{_ASSET},media_type:string,time:struct<start_ms:bigint,end_ms:bigint>,region:{_BOX},caption_source:string,thumbnail:{_ASSET}>"

GID = ("collection", "doc_id", "chunk_id")


def chunk_schema() -> str:
    """DDL of the chunk table."""
    return (
        f"collection string, doc_id string, chunk_id bigint, kind string, text string, page int, bbox {_BOX}, heading_path array<string>, "
        f"section_id bigint, char_len int, media {MEDIA}, image_vector_status string, tenant string, acl array<string>, metadata string, "
        "searchable boolean, embedding array<float>, embed_model string, updated_at timestamp"
    )


def modality(kind: Column) -> Column:
    """Image, audio and video are their own modality; all other kinds are text."""
    return F.when(kind.isin("image", "audio", "video"), kind).otherwise(F.lit("text"))


def complete(chunks: DataFrame) -> DataFrame:
    """The columns that searches need, with their defaults where the input lacks them or has nulls."""
    have = set(chunks.columns)
    col = lambda name, type_, default=None: (F.coalesce(F.col(name).cast(type_), F.lit(default).cast(type_)) if default is not None else F.col(name).cast(type_)) if name in have else F.lit(default).cast(type_)
    media = chunks.select("media").schema[0].dataType if "media" in have else None
    time = F.col("media.time") if media is not None and isinstance(media, T.StructType) and "time" in media.names else None
    bound = lambda name, part: F.coalesce(time[part], col(name, "bigint")) if time is not None else col(name, "bigint")
    acl = F.coalesce(F.col("acl"), F.array(F.lit("public"))) if "acl" in have else F.array(F.lit("public"))
    path = F.coalesce(F.col("heading_path"), F.array().cast("array<string>")) if "heading_path" in have else F.array().cast("array<string>")
    out = {
        "collection": col("collection", "string", "default"),
        "doc_id": col("doc_id", "string"),
        "chunk_id": col("chunk_id", "bigint"),
        "kind": col("kind", "string", "paragraph"),
        "text": col("text", "string", ""),
        "page": col("page", "int", 1),
        "section_id": col("section_id", "bigint", 0),
        "heading_path": path,
        "tenant": col("tenant", "string"),
        "acl": acl,
        "metadata": col("metadata", "string", "{}"),
        "searchable": col("searchable", "boolean", True),
        "time_start_ms": bound("time_start_ms", "start_ms"),
        "time_end_ms": bound("time_end_ms", "end_ms"),
    }
    rest = [F.col(c) for c in chunks.columns if c not in out and c != "modality"]
    df = chunks.select(*[c.alias(n) for n, c in out.items()], *rest)
    return df.withColumn("modality", modality(F.col("kind")))


def citation_id() -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in GID])


def parse_citation(c: Column) -> Column:
    """struct(collection, doc_id, chunk_id), or null: the first colon ends the collection, the last starts the number."""
    pattern = r"^([^:]+):(.+):([0-9]{1,19})$"
    number = F.regexp_extract(c, pattern, 3).try_cast("bigint")
    return F.when(c.rlike(pattern) & number.isNotNull(), F.struct(F.regexp_extract(c, pattern, 1).alias("collection"), F.regexp_extract(c, pattern, 2).alias("doc_id"), number.alias("chunk_id")))


def split_citation(text: str) -> tuple[str, str, int] | None:
    head, _, rest = text.partition(":")
    doc, colon, tail = rest.rpartition(":")
    if not (head and doc and colon and tail.isascii() and tail.isdigit()) or int(tail) >= 1 << 63:
        return None
    return head, doc, int(tail)


def encode_cursor(key: float, citation: str) -> str:
    """The sort key's 64 bits in hex, and the citation of the last row."""
    return struct.pack(">d", key).hex() + ":" + citation


def decode_cursor(cursor: str) -> tuple[float, tuple[str, str, int]]:
    bits, _, citation = cursor.partition(":")
    gid = split_citation(citation)
    if len(bits) != 16 or gid is None:
        raise ValueError(f"not a cursor: {cursor!r}")
    return struct.unpack(">d", bytes.fromhex(bits))[0], gid


def check_metadata(text: str) -> None:
    """Raise ValueError if a metadata object is too large, too wide or too deep."""
    if len(text.encode()) > METADATA_BYTES:
        raise ValueError("metadata has too many bytes")
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("metadata is no object")
    keys, stack = 0, [(value, 1)]
    while stack:
        v, depth = stack.pop()
        if isinstance(v, (dict, list)):
            if depth > METADATA_DEPTH:
                raise ValueError("metadata is too deep")
            keys += len(v) if isinstance(v, dict) else 0
            stack += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v)]
    if keys > METADATA_KEYS:
        raise ValueError("metadata has too many keys")
