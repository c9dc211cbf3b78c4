"""Vectorised text primitives shared by the corpus operators.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes of the
UTF-8 text; ASCII and Latin-1 letters are folded to lower case.  Words are
hashed to 64 bits straight from Arrow's character buffer, so no Python string
is made per word.  Everything works in blocks: memory does not depend on the
length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

_byte = np.arange(256)
IS_WORD = (
    ((_byte >= 48) & (_byte <= 57))
    | ((_byte >= 65) & (_byte <= 90))
    | ((_byte >= 97) & (_byte <= 122))
    | (_byte >= 128)
)
FOLD = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_N = 0xD6E8FEB86659FD93
_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    t = _tables.get(name)
    if t is None or len(t) < n:
        t = np.full(max(n, BLOCK + 1), base, np.uint64)
        t[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(t, out=t)
        _tables[name] = t
    return t[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on uint64 (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fold_bytes(b: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; the length stays."""
    f = FOLD[b]
    upper = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)) + 1
    f[upper] += 0x20
    return f


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of an Arrow string array and its len+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: index of its text, first byte, byte after the last (both in ``buf``), hash."""
    parts, pos, n = [], 0, len(buf)
    while pos < n:
        stop = min(n, pos + BLOCK)
        while stop < n:
            gaps = np.flatnonzero(~IS_WORD[buf[pos:stop]])
            if len(gaps):
                stop = pos + int(gaps[-1]) + 1
                break
            stop = min(n, stop + BLOCK)
        parts.append(_block(buf, offs, pos, stop))
        pos = stop
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _block(buf, offs, pos, stop):
    b = buf[pos:stop]
    w = IS_WORD[b]
    first = w.copy()
    first[1:] &= ~w[:-1]
    inside = offs[np.searchsorted(offs, pos) : np.searchsorted(offs, stop)] - pos
    first[inside] |= w[inside]
    last = w.copy()
    last[:-1] &= ~w[1:]
    before = inside[inside > 0] - 1
    last[before] |= w[before]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        h = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((fold_bytes(b).astype(np.uint64) + np.uint64(1)) * _powers("p", _P, len(b)), out=h[1:])
        h = (h[e] - h[s]) * _powers("inv", _P_INV, len(b) + 1)[s]
    return np.searchsorted(offs, s + pos, "right") - 1, s + pos, e + pos, mix(h)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (those that cross texts too)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            g = g * np.uint64(_N) + h[k : len(h) - n + 1 + k]
    return mix(g)


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text (a longer text alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, o = buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(o, o[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
