"""Embedders: what makes vectors of texts and images, and which chunks get one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vector import hash_embedding


class Transient(Exception):
    """A failure that may pass: the call is repeated."""


@dataclass(frozen=True)
class Embedder:
    """texts and images: functions from a list to as many vectors of ``dim`` components.

    cross_modal: vectors of texts and images can be compared.  A batch has
    ``batch`` inputs; after a Transient failure it is tried ``retries`` times
    more, after ``wait`` seconds, twice that, and so on.
    """

    dim: int
    texts: Callable[[list[str]], list]
    images: Callable[[list[bytes]], list] | None = None
    cross_modal: bool = False
    query_prefix: str = "query: "
    passage_prefix: str = "passage: "
    batch: int = 64
    retries: int = 2
    wait: float = 0.1

    def _call(self, f: Callable, inputs: list) -> list:
        for attempt in range(self.retries + 1):
            try:
                out = f(inputs)
                break
            except Transient:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * 2**attempt)
        if len(out) != len(inputs) or any(len(v) != self.dim for v in out):
            raise ValueError(f"the embedder owes {len(inputs)} vectors of {self.dim} components")
        return [[float(x) for x in v] for v in out]

    def query(self, text: str) -> list[float]:
        return self._call(self.texts, [self.query_prefix + text])[0]

    def column(self, value: Column, image: bool = False) -> Column:
        """Vectors of a column of passages, or of images; null for null."""
        f, prefix = (self.images if image else self.texts), "" if image else self.passage_prefix

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for rows in batches:
                out: list = [None] * len(rows)
                some = [i for i, x in enumerate(rows) if x is not None]
                for s in range(0, len(some), self.batch):
                    part = some[s : s + self.batch]
                    for i, v in zip(part, self._call(f, [rows.iloc[i] if image else prefix + rows.iloc[i] for i in part])):
                        out[i] = v
                yield pd.Series(out)

        return embed(value)


def hashed(text: Column, dim: int, query: bool = False) -> Column:
    """The embedder that needs no model: hashed words with the prefix of their role."""
    return hash_embedding(tokens(text), dim, "query: " if query else "passage: ")


def route(chunks: DataFrame, cross_modal: bool, images: bool = True) -> DataFrame:
    """chunks with embed_as ("text", "image" or null) and image_vector_status.

    Searchable chunks without a vector are embedded: images by their bytes
    (media_bytes) if the embedder compares images with texts, else by their
    caption; all others by their text.  An image without either waits for its
    bytes if its media names some (pending), else misses them (missing_bytes).
    """
    have = set(chunks.columns)
    todo = F.col("searchable") & (F.col("embedding").isNull() if "embedding" in have else F.lit(True))
    caption = F.trim(F.coalesce("text", F.lit(""))) != ""
    data = F.col("media_bytes").isNotNull() if "media_bytes" in have else F.lit(False)
    named = F.col("media").isNotNull() if "media" in have else F.lit(False)
    is_image = F.col("kind") == "image"
    by_image = is_image & data & F.lit(cross_modal and images)
    how = F.when(todo & by_image, "image").when(todo & caption, "text")
    old = F.col("image_vector_status") if "image_vector_status" in have else F.lit(None).cast("string")
    status = F.when(~is_image, F.lit(None).cast("string")).when(~todo, old).when(by_image, "embedded").when(caption, "text_fallback").when(named & ~F.lit(cross_modal and images), "pending").otherwise("missing_bytes")
    return chunks.withColumns({"embed_as": how, "image_vector_status": status})


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """chunks with vectors where ``route`` wants one; those that have one keep it."""
    routed = route(chunks, embedder.cross_modal, embedder.images is not None)
    own = F.col("embedding") if "embedding" in chunks.columns else F.lit(None).cast("array<float>")
    vector = F.when(F.col("embed_as") == "text", embedder.column(F.when(F.col("embed_as") == "text", F.col("text"))))
    if embedder.images is not None and embedder.cross_modal and "media_bytes" in chunks.columns:
        vector = F.coalesce(vector, embedder.column(F.when(F.col("embed_as") == "image", F.col("media_bytes")), True))
    return routed.withColumn("embedding", F.coalesce(own, vector)).drop("embed_as")
