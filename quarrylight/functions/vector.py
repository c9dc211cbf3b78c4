"""Vector functions on columns, and the arithmetic of quantisers on the driver."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A vector shorter than this, or with a length that is no number, counts as zero.
EPSILON = 1.1920929e-7


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l1(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: F.abs(x.cast("double"))))


def cosine(v: Column, q: list[float]) -> Column:
    """With a constant query; a zero vector on either side scores 0."""
    n = math.sqrt(sum(x * x for x in q))
    if not n > EPSILON or not math.isfinite(n):
        return F.lit(0.0)
    length = l2(v)
    return F.when((length > EPSILON) & (length < float("inf")), dot(v, F.array(*[F.lit(float(x)) for x in q])) / (length * F.lit(n))).otherwise(0.0)


#: Tokens that are hashed at once.
TOKENS = 500_000


def _hashed(rows: pa.ListArray, dim: int, prefix: str) -> np.ndarray:
    """Unit vectors of lists of tokens; only distinct tokens become Python's strings."""
    size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy()
    coded = rows.flatten().dictionary_encode()
    digests = [hashlib.md5((prefix + w).encode()).hexdigest() for w in coded.dictionary.to_pylist()]
    at = np.array([int(x[:8], 16) % dim for x in digests], np.int64)
    by = np.array([1.0 - 2.0 * (int(x[8:16], 16) % 2) for x in digests])
    code = coded.indices.to_numpy()
    out = np.bincount(np.repeat(np.arange(len(rows)), size) * dim + at[code], by[code], len(rows) * dim).reshape(len(rows), dim)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def hash_embedding(tokens: Column, dim: int, prefix: str = "") -> Column:
    """Each token adds +1 or -1 at a place that its md5 names; then unit length.  Linear: a token is hashed once for some rows of about TOKENS."""

    @F.arrow_udf("array<float>")
    def embed(rows: pa.Array) -> pa.Array:
        done = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64))
        parts, start = [], 0
        while start < len(rows):
            end = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + TOKENS, "right")))
            parts.append(_hashed(rows.slice(start, end - start), dim, prefix))
            start = end
        x = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.reshape(-1)))

    return embed(tokens)


def signs(n: int, rounds: int, seed: int) -> np.ndarray:
    """Reproducible +1/-1 from a 64-bit xorshift."""
    state, out = (seed | 1) & (1 << 64) - 1, np.empty((rounds, n), np.float32)
    for r in range(rounds):
        for i in range(n):
            state ^= state << 13 & (1 << 64) - 1
            state ^= state >> 7
            state ^= state << 17 & (1 << 64) - 1
            out[r, i] = 1.0 if state >> 33 & 1 else -1.0
    return out


def rotate(x: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """Rows padded to a power of two; sign flips and a Walsh-Hadamard transform, once for each row of flips."""
    n = flips.shape[1]
    y = np.zeros((len(x), n), np.float32)
    y[:, : x.shape[1]] = x
    for f in flips:
        y *= f
        h = 1
        while h < n:
            z = y.reshape(len(y), -1, 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), n)
            h *= 2
        y /= np.float32(math.sqrt(n))
    return y


def rotation(dim: int, seed: int = 0x51A7, rounds: int = 3) -> np.ndarray:
    if not 1 <= dim <= 8192:
        raise ValueError("dimension is from 1 to 8192")
    return signs(1 << max(0, (dim - 1).bit_length()), rounds, seed)


def gaussian_codebook(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(levels, boundaries) that quantise a standard normal value with least squared error."""
    if bits not in (2, 3, 4):
        raise ValueError("bits is 2, 3 or 4")
    pdf = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = lambda x: np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
    k = 1 << bits
    levels = np.linspace(-3, 3, k)
    for _ in range(500):
        edges = np.concatenate([[-40.0], (levels[1:] + levels[:-1]) / 2, [40.0]])
        mass = np.maximum(np.diff(cdf(edges)), 1e-300)
        new = (pdf(edges[:-1]) - pdf(edges[1:])) / mass
        if np.abs(new - levels).max() < 1e-12:
            break
        levels = new
    return new, (new[1:] + new[:-1]) / 2


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return np.where((n > EPSILON) & np.isfinite(n), x / np.where(n > 0, n, 1), 0).astype(np.float32)
