"""Vector search: exact, in batches, over compressed codes, and over clusters.

Access and filters come before scores, so every method ranks only what the
caller may see.  Compressed methods end with an exact rescoring of a wider
list; the clustered one widens its probes until it has enough hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..model import GID
from .ranking import top

def check_vector(q: list[float], dim: int | None = None) -> list[float]:
    q = [float(x) for x in q]
    if not q or not all(np.isfinite(q)):
        raise ValueError("a vector has finite components")
    if dim is not None and len(q) != dim:
        raise ValueError(f"the vector has {len(q)} components, the index {dim}")
    return q


def knn(chunks: DataFrame, q: list[float], k: int, where: Column | None = None, column: str = "embedding") -> DataFrame:
    """The k chunks of greatest cosine similarity, with their columns and vector (the similarity)."""
    rows = chunks.where(F.col("searchable") & F.col(column).isNotNull()).where(F.lit(True) if where is None else where)
    q = check_vector(q)
    wrong = F.size(column) != len(q)
    score = F.when(wrong, F.raise_error(F.lit(f"the index's vectors don't have {len(q)} components"))).otherwise(V.cosine(F.col(column), q))
    return top(rows.withColumn("vector", score), "vector", k)


def _best_of_block(k: int):
    """The k best (and ties) of a block of chunks for each query of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("collection", pa.string()), ("doc_id", pa.string()), ("chunk_id", pa.int64()), ("vector", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        x, q = (V.unit(np.asarray(t["v"].combine_chunks().flatten(), np.float32).reshape(len(t), -1)).astype(np.float64) for t in (left, right))
        s = x @ q.T
        m = min(k, len(x))
        i, j = np.nonzero(s >= np.partition(s, len(x) - m, axis=0)[len(x) - m])
        return pa.Table.from_arrays([right["query_id"].take(pa.array(j)), *(left[c].take(pa.array(i)) for c in GID), pa.array(s[i, j])], schema=schema)

    return run


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int, where: Column | None = None, column: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, gid, vector): the k nearest for each query of (query_id bigint, vector).

    Blocks of about ``block`` chunks meet blocks of as many queries, each pair
    of blocks in a task of its own: a matrix product that leaves the k best (and
    ties) a query, which one shuffle ranks.  Neither side is collected.
    """
    rows = chunks.where(F.col("searchable") & F.col(column).isNotNull()).where(F.lit(True) if where is None else where).select(*GID, F.col(column).cast("array<float>").alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("v"))
    n, m = (max(1, -(-df.count() // block)) for df in (rows, asked))
    grid = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = rows.withColumn("i", F.pmod(F.xxhash64(*GID), F.lit(n)).cast("int")).withColumn("j", grid(m))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).withColumn("i", grid(n))
    hits = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_best_of_block(k), "query_id long, collection string, doc_id string, chunk_id long, vector double")
    return top(hits, "vector", k, ["query_id"])


def binary_codes(chunks: DataFrame, column: str = "embedding") -> DataFrame:
    """(gid, code, l1): a bit for each component that isn't negative, and the sum of magnitudes of the unit vector."""
    n = V.l2(F.col(column))
    bits = F.array_join(F.transform(column, lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    return chunks.where(F.col(column).isNotNull()).select(*GID, bits.alias("code"), F.when(n > V.EPSILON, V.l1(F.col(column)) / n).otherwise(0.0).alias("l1"))


def two_stage(chunks: DataFrame, q: list[float], k: int, oversample: int = 8, where: Column | None = None, column: str = "embedding") -> DataFrame:
    """knn by one-bit codes: <q, sign x> / |x|_1 picks k * oversample, exact cosine the k of those."""
    rows = chunks.where(F.col("searchable") & F.col(column).isNotNull()).where(F.lit(True) if where is None else where)
    q = check_vector(q)
    size = V.l1(F.col(column))
    signed = V.dot(F.transform(column, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0)), F.array(*[F.lit(x) for x in q]))
    coarse = top(rows.withColumn("estimate", F.when(size > 0, signed / size * V.l2(F.col(column))).otherwise(0.0)), "estimate", k * max(1, oversample))
    return top(coarse.withColumn("vector", V.cosine(F.col(column), q)), "vector", k).drop("estimate")


class CompressedIndex:
    """Rotated vectors, quantised to a few bits a component, as a table (gid, code, correction)."""

    def __init__(self, codes: DataFrame, dim: int, bits: int, flips: np.ndarray):
        self.codes, self.dim, self.bits, self.flips = codes, dim, bits, flips

    @classmethod
    def build(cls, chunks: DataFrame, dim: int, bits: int = 4, seed: int = 0x51A7, column: str = "embedding") -> CompressedIndex:
        flips = V.rotation(dim, seed)
        levels, edges = V.gaussian_codebook(bits) if bits > 1 else (np.array([-1.0, 1.0]), np.array([0.0]))

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = V.rotate(V.unit(np.stack(f[column].to_numpy()).astype(np.float32)), flips) if len(f) else np.zeros((0, flips.shape[1]), np.float32)
                c = np.searchsorted(edges, x * np.sqrt(flips.shape[1])).astype(np.uint8)
                y = levels[c]
                along = (x * y).sum(axis=1)
                out = f[list(GID)].copy()
                out["code"] = [np.packbits(np.unpackbits(r[:, None], axis=1)[:, -bits:]).tobytes() for r in c]
                out["correction"] = np.where(along > 0, 1.0 / np.where(along > 0, along, 1), 0.0)
                yield out

        rows = chunks.where(F.col("searchable") & F.col(column).isNotNull()).select(*GID, column)
        return cls(rows.mapInPandas(encode, "collection string, doc_id string, chunk_id long, code binary, correction double"), dim, bits, flips)

    def search(self, q: list[float], k: int, allowed: DataFrame | None = None, chunks: DataFrame | None = None, oversample: int = 8, column: str = "embedding") -> DataFrame:
        """(gid, vector): by codes alone, or, given the chunks, rescored exactly from k * oversample candidates."""
        q = check_vector(q, self.dim)
        bits, width = self.bits, self.flips.shape[1]
        levels = V.gaussian_codebook(bits)[0] if bits > 1 else np.array([-1.0, 1.0])
        table = V.rotate(V.unit(np.array([q], np.float32)), self.flips)[0][:, None] * levels[None, :]

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = f[list(GID)].copy()
                if len(f):
                    raw = np.unpackbits(np.frombuffer(b"".join(f["code"]), np.uint8).reshape(len(f), -1), axis=1)[:, : width * bits]
                    c = (raw.reshape(len(f), width, bits) * (1 << np.arange(bits)[::-1])).sum(axis=2)
                    out["vector"] = table[np.arange(width), c].sum(axis=1) * f["correction"].to_numpy()
                else:
                    out["vector"] = pd.Series(dtype=float)
                yield out

        codes = self.codes if allowed is None else self.codes.join(allowed.select(*GID), list(GID), "left_semi")
        coarse = codes.mapInPandas(score, "collection string, doc_id string, chunk_id long, vector double")
        if chunks is None:
            return top(coarse, "vector", k)
        wide = top(coarse, "vector", k * max(1, oversample)).drop("vector")
        return top(chunks.join(wide, list(GID)).withColumn("vector", V.cosine(F.col(column), q)), "vector", k).select(*GID, "vector")


class ClusterIndex:
    """Vectors by nearest of a few centroids; a search reads the nearest clusters only.

    Stored by cluster (``save``), clusters that aren't probed aren't read.  The
    sample that trains the centroids is bounded; every vector is assigned.
    """

    #: Up to so many vectors a search reads all of them.
    EXACT = 1000

    def __init__(self, rows: DataFrame, centroids: np.ndarray, n: int):
        self.rows, self.centroids, self.n = rows, centroids, n

    @classmethod
    def build(cls, chunks: DataFrame, clusters: int | None = None, train_rows: int = 20_000, rounds: int = 12, seed: int = 3, column: str = "embedding") -> ClusterIndex:
        rows = chunks.where(F.col("searchable") & F.col(column).isNotNull())
        n = rows.count()
        clusters = clusters or max(1, int(np.sqrt(n)))
        share = min(1.0, train_rows / max(1, n))
        sample = rows.where(F.pmod(F.xxhash64(*GID), F.lit(1_000_000)) < int(1_000_000 * share)).orderBy(*GID).select(column).toPandas()
        x = V.unit(np.stack(sample[column].to_numpy()).astype(np.float32)) if len(sample) else np.zeros((0, 1), np.float32)
        centroids = x[np.random.default_rng(seed).permutation(len(x))[: min(clusters, len(x))]]
        for _ in range(rounds):
            own = (x @ centroids.T).argmax(axis=1) if len(centroids) else np.zeros(0, int)
            total = np.zeros_like(centroids)
            np.add.at(total, own, x)
            centroids = np.where(np.bincount(own, minlength=len(centroids))[:, None] > 0, V.unit(total), centroids)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            return pd.Series((V.unit(np.stack(v.to_numpy()).astype(np.float32)) @ centroids.T).argmax(axis=1).astype(np.int32))

        return cls(rows.withColumn("cluster", nearest(F.col(column))) if len(centroids) else rows.withColumn("cluster", F.lit(0)), centroids, n)

    def save(self, path: str) -> None:
        # a hot cluster is several files: rows of one are spread by their identifiers
        self.rows.repartition("cluster", F.pmod(F.xxhash64(*GID), F.lit(max(1, self.n // 2_000_000)))).write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c.tolist(), self.n) for i, c in enumerate(self.centroids)], "cluster int, center array<float>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load(cls, spark, path: str) -> ClusterIndex:
        c = spark.read.parquet(f"{path}/centroids").orderBy("cluster").toPandas()
        if not len(c):
            return cls(spark.read.parquet(f"{path}/vectors"), np.zeros((0, 1), np.float32), 0)
        return cls(spark.read.parquet(f"{path}/vectors"), np.stack(c["center"].to_numpy()).astype(np.float32), int(c["n"][0]))

    def search(self, q: list[float], k: int, probes: int | None = None, where: Column | None = None, column: str = "embedding") -> DataFrame:
        """As knn, over the ``probes`` clusters whose centroids are nearest; by default a quarter of them, 10 at least.

        Four times the clusters are probed while there are fewer than k hits.
        With all clusters, or up to EXACT vectors, it is exact.
        """
        q = check_vector(q, self.centroids.shape[1] if len(self.centroids) else None)
        order = np.argsort(-(self.centroids @ V.unit(np.array([q], np.float32))[0]), kind="stable").tolist()
        probes = max(1, probes) if probes else max(10, len(order) // 4)
        if self.n <= self.EXACT:
            probes = len(order)
        while True:
            near = order[:probes]
            hits = knn(self.rows.where(F.col("cluster").isin(near)) if probes < len(order) else self.rows, q, k, where, column)
            if probes >= len(order) or hits.count() >= k:
                return hits.drop("cluster")
            probes *= 4
