"""N-gram Jaccard self-join by token-combination prefixes.

A document is the set of its word n-grams ("tokens" below); two documents join
when the Jaccard similarity of their sets reaches a threshold.  The join is
exact, up to collisions of 64-bit hashes.  It uses k-wise signatures: tokens
are ordered from rare to frequent and divided into classes by document
frequency.  A rare token of a document's prefix is a signature by itself; of
the frequent class every pair, of the most frequent class every triple of
prefix tokens is one.  To stay complete the prefix is extended: with p_c of
its tokens in class c it must satisfy sum max(0, p_c - (c - 1)) >= |x| - a + 1,
where a = ceil(t |x|) is the least overlap with any partner.  At most |x| - a
tokens can be missing from a partner, so at least c tokens of some class c
survive in both prefixes.  Sets too small for that sum (under 8 / t tokens)
use single tokens only; sets up to 1 / t times as large emit both kinds, so
that every possible pair meets in one of them.

Plan: documents -> packed (token, set) by token range (shuffle 1) -> document
frequencies; tokens of one set only match nothing and end here -> back to
their sets (shuffle 2, what is repeated only), of which those with fewer than
a repeated tokens end here, as no partner overlaps them enough -> signatures (shuffle 3) ->
groups of sets connected by signatures, which hold every candidate pair ->
each group's pairs verified at once, as a matrix product over its repeated
tokens, which hold every intersection.  Frequent n-grams tie much of a corpus
into one group, so in large groups a signature connects only sets that may
reach the threshold by bit sketches of their tokens, which bound every overlap
from above; what that leaves large is signed again with wider sketches where
its sets have too many tokens for the first.  What is large even then is parted: Jaccard distance is a metric, so sets within half the greatest distance of a centre all
link to each other and need no comparing, and only sets within one and a half
of it can link to any of them.  A task returns the links of each of its
sets as a number and the sets they connect as a forest, never pairs.  Rows
travel packed, because a Spark row for each of the corpus's n-grams would be
several times the corpus.  Documents with equal sets are one set with a number
of documents throughout, and the ids of a set are never gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpoint, pack, text_bytes, unpack
from .components import components, local_components
from .textkernel import buffers, mix, ngrams, pieces, words

#: Document frequencies up to which a token is of class 1 and 2: shares of all sets, and at least so many.
CLASSES = ((0.01, 256), (0.05, 1024))
#: Bits of a token's hash that tell it from the others of its range (some millions).
TOKEN_BITS = 42
#: N-grams a task gathers before it packs them; bytes of text whose n-grams a reducer handles at once, and how many such pieces it has.
FLUSH, BYTES_EACH, PIECES = 1_500_000, 18_000_000, 4
#: Bits of a set's sketch; pairs of such sketches compared at once; pairs of a signature above which its sets are connected without looking.
SKETCH, AT_ONCE, CROWD = 1024, 100_000, 20_000_000
#: Bits of the sketch of sets in groups that SKETCH leaves large, because it is full for sets of about as many tokens; tokens of such sets for each partition.
WIDE, WIDE_EACH = 8192, 8_000_000
#: Turns a document without words into a set of its own.
_ALONE = np.uint64(0xA54FF53A5F1D36F1)

_SMALL = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("body", pa.binary()), ("sets", pa.binary())])
_ROWS = "part int, kind int, body binary, sets binary"
_ITEM = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("size", pa.int32()), ("body", pa.binary())])
_MEMBER = pa.schema([("set", pa.int64()), ("id", pa.int64())])


def _bounds(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _tokens(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, token), not distinct yet.  A text of 1 to n-1 words is one token."""
    d, _, _, h = words(*buffers(texts))
    g = ngrams(h, n)
    whole = d[: len(g)] == d[n - 1 :] if len(g) else np.zeros(0, bool)
    gd, g = d[: len(g)][whole], g[whole]
    count = np.bincount(d, minlength=len(texts))
    for k in range(1, n):
        of = np.flatnonzero(count == k)
        if len(of):
            at = np.searchsorted(d, of)
            gd, g = np.concatenate([gd, of]), np.concatenate([g, ngrams(h, k)[at] ^ np.uint64(k)])
    return gd, g


def _spread(n: int, parts: int, subs: int):
    """Kind 0: (token, set) by token range, in ``subs`` pieces that a reducer reads one by one; kind 1: sizes by set; kind 2: (set, id), anywhere."""

    def flush(gd, g, ids, null) -> pa.RecordBatch:
        o = np.argsort(g)
        gd, g = gd[o], g[o]
        b = _bounds(g)
        many = np.repeat(np.diff(b) > 1, np.diff(b))
        if many.any():  # a token repeated within a text counts once
            code = np.lexsort((gd[many], g[many]))
            x, y = g[many][code], gd[many][code]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            gd, g = np.concatenate([gd[~many], y[new]]), np.concatenate([g[~many], x[new]])
            o = np.argsort(g, kind="stable")
            gd, g = gd[o], g[o]
        size = np.bincount(gd, minlength=len(ids)).astype(np.uint32)
        total = np.zeros(len(ids), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(total, gd, mix(g))
            sig = mix(total + size)
        order = np.argsort(sig)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rows = []
        edges = np.array([(k << 64) // (parts * subs) for k in range(parts * subs)], np.uint64)
        b = np.append(np.searchsorted(g, edges), len(g))
        for part in range(parts):
            s, e = b[part * subs], b[(part + 1) * subs]
            if e > s:
                own, at = np.unique(rank[gd[s:e]], return_inverse=True)
                at = at.astype(np.uint16 if len(own) < 65536 else np.uint32)
                bodies = []
                for k in range(part * subs, (part + 1) * subs):
                    x = g[b[k] : b[k + 1]] >> np.uint64(max(0, 64 - TOKEN_BITS - (parts * subs).bit_length()))
                    bodies.append(pack(np.diff(x, prepend=np.uint64(0)), at[b[k] - s : b[k + 1] - s]))
                rows.append((part, 0, np.array([len(x) for x in bodies], np.int64).tobytes() + b"".join(bodies), pack(np.diff(sig[order[own]], prepend=np.uint64(0)))))
        own, at = np.unique(sig[size > 0], return_index=True)
        of = size[size > 0][at]
        home = (own % np.uint64(parts)).astype(np.int64)
        o = np.argsort(home)
        own, of, home = own[o], of[o], home[o]
        b = _bounds(home)
        rows += [(int(home[s]), 1, pack(own[s:e], of[s:e]), None) for s, e in zip(b[:-1], b[1:])]
        here = np.where(size > 0, sig, mix(ids.view(np.uint64) ^ _ALONE))[~null]
        if len(here):
            rows.append((int(here[0] % np.uint64(parts)), 2, pack(here, ids[~null]), None))
        return _batch(_SMALL, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, null, rows, count = [], [], [], 0, 0

        def all_of():
            return flush(*map(np.concatenate, zip(*held)), np.concatenate(ids), np.concatenate(null))

        for batch in pieces(batches, "text"):
            gd, g = _tokens(batch.column("text"), n)
            held.append((gd + rows, g))
            ids.append(np.asarray(batch.column("id").fill_null(0)))
            null.append(np.asarray(batch.column("id").is_null()))
            rows, count = rows + batch.num_rows, count + len(g)
            if count > FLUSH:
                yield all_of()
                held, ids, null, rows, count = [], [], [], 0, 0
        if held:
            yield all_of()

    return run


def _count(parts: int, subs: int):
    """Of each token range: the tokens of two or more sets, with frequency, sent to their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], 0
        for batch in batches:
            for p, kind, body, sets in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    yield _batch(_SMALL, [(p, kind, body, sets)])
                else:
                    part = p
                    ends = 8 * subs + np.cumsum(np.frombuffer(body[: 8 * subs], np.int64))
                    held.append(([body[s:e] for s, e in zip([8 * subs, *ends[:-1]], ends)], sets))
        found = []
        for k in range(subs if held else 0):
            low, sig = [], []
            for bodies, sets in held:
                own = np.cumsum(unpack(sets, np.uint64)[0], dtype=np.uint64)
                delta, of = unpack(bodies[k], np.uint64, np.uint16 if len(own) < 65536 else np.uint32)
                bodies[k] = None  # what is found takes its place in memory
                low.append(np.cumsum(delta, dtype=np.uint64))
                sig.append(own[of])
            low, sig = np.concatenate(low), np.concatenate(sig)
            found.append(repeated(low, sig))
        for home in range(parts if found else 0):  # a set is named once for all pieces of the range
            rows = []
            for k, bodies in enumerate(found):
                if bodies[home]:
                    delta, tok, df = unpack(bodies[home], np.uint64, np.uint32, np.uint32)
                    rows.append((np.cumsum(delta, dtype=np.uint64), tok + np.uint64((part * subs + k) << 32), df))
            if rows:
                sig, tok, df = map(np.concatenate, zip(*rows))
                o = np.lexsort((tok, sig))
                yield _batch(_SMALL, [(home, 0, pack(np.diff(sig[o], prepend=np.uint64(0)), tok[o], df[o]), b"")])

    def repeated(low: np.ndarray, sig: np.ndarray) -> list[bytes]:
        """For each home of sets: sets, tokens by their number in the piece, frequencies; packed, to take little memory until all pieces are read."""
        o = np.argsort(low, kind="stable")
        low, sig = low[o], sig[o]
        b = _bounds(low)
        many = np.repeat(np.diff(b) > 1, np.diff(b))
        low, sig = low[many], sig[many]
        o = np.lexsort((sig, low))
        low, sig = low[o], sig[o]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (sig[1:] != sig[:-1])
        low, sig = low[new], sig[new]
        b = _bounds(low)
        df = np.diff(b)
        tok = np.repeat(np.arange(len(df), dtype=np.uint32), df)
        df = np.repeat(df, df)
        keep = df > 1
        tok, sig, df = tok[keep], sig[keep], df[keep].astype(np.uint32)
        home = (sig % np.uint64(parts)).astype(np.int64)
        o = np.lexsort((sig, home))
        tok, sig, df = tok[o], sig[o], df[o]
        b = np.searchsorted(home[o], np.arange(parts + 1))
        return [pack(np.diff(sig[s:e], prepend=np.uint64(0)), tok[s:e], df[s:e]) if e > s else b"" for s, e in zip(b[:-1], b[1:])]

    return run


def _gather(t: float):
    """Kind 0: a set (a) with its size and repeated tokens, or no body where those are too few for any partner; kind 2: packed sets and ids, as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = [], []
        for batch in batches:
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
                if kind == 2:
                    yield _batch(_ITEM, [(2, 0, 0, body)])
                elif kind == 1:
                    mine.append(unpack(body, np.uint64, np.uint32))
                else:
                    delta, tok, df = unpack(body, np.uint64, np.uint64, np.uint32)
                    held.append((np.cumsum(delta, dtype=np.uint64), tok, df))
        if not mine or not held:
            return
        sig, size = map(np.concatenate, zip(*mine))
        sig, first = np.unique(sig, return_index=True)
        size = size[first]
        ts, tok, df = map(np.concatenate, zip(*held))
        o = np.lexsort((tok, ts))
        ts, tok, df = ts[o], tok[o], df[o]
        rows = []
        for x, n, s, e in zip(sig, size, np.searchsorted(ts, sig), np.searchsorted(ts, sig, "right")):
            if e > s:
                able = e - s >= math.ceil(t * int(n) - 1e-9)
                rows.append((0, int(x.view(np.int64)), int(n), pack(np.diff(tok[s:e], prepend=np.uint64(0)), df[s:e]) if able else b""))
                if len(rows) == 2000:
                    yield _batch(_ITEM, rows)
                    rows = []
        if rows:
            yield _batch(_ITEM, rows)

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column("body").to_pylist():
            own, ids = unpack(body, np.uint64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(ids)], schema=_MEMBER)


def signatures(tok: np.ndarray, df: np.ndarray, size: int, t: float, classes: tuple[int, int]) -> np.ndarray:
    """Those of a set, from its repeated tokens; the other size - len(tok) ones come first in the order."""
    o = np.lexsort((tok, df))
    tok, df = tok[o], df[o]
    need = size - math.ceil(t * size - 1e-9) + 1 - (size - len(tok))
    least = math.ceil(8 / t)
    out = []
    if need > 0 and size < least / t:
        out.append(mix(tok[:need]))
    if need > 0 and size >= least:
        c = np.searchsorted(df, np.array(classes), "right")
        x = tok[: min(need, c[0])]
        out.append(mix(x ^ np.uint64(1 << 63)))
        need -= len(x)
        if need > 0:
            x = mix(tok[c[0] : min(c[1], c[0] + need + 1)])
            i, j = np.triu_indices(len(x), 1)
            out.append(mix(x[i] * np.uint64(3) + x[j]))
            need -= max(0, len(x) - 1)
        if need > 0:
            x = mix(tok[c[1] : c[1] + need + 2])
            for k in range(len(x) - 2):
                i, j = np.triu_indices(len(x) - k - 1, 1)
                out.append(mix((x[k] * np.uint64(5) + x[k + 1 :][i]) * np.uint64(3) + x[k + 1 :][j]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(tok: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """Parities of the tokens by hash: two sets differ in at least as many tokens as their sketches in bits."""
    return np.packbits(np.bincount((mix(tok) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1)


def _sign(t: float, parts: int, classes: tuple[int, int], sketches: int = 0):
    """(signature, set) by signature; on request with size, number of repeated tokens and sketch, of so many bits, of the sets."""

    def flush(held, about) -> pa.RecordBatch:
        keys = np.concatenate(held)
        at = np.repeat(np.arange(len(held)), [len(x) for x in held])
        a, size, rep = (np.array(x, k) for x, k in zip(list(zip(*about))[:3], (np.int64, np.uint32, np.uint32)))
        part = (keys % np.uint64(parts)).astype(np.int64)
        o = np.lexsort((keys, part))
        keys, at, part = keys[o], at[o], part[o]
        b = _bounds(part)
        rows = []
        for s, e in zip(b[:-1], b[1:]):
            sets = None
            if sketches:
                x = np.unique(at[s:e])
                sets = pack(a[x], size[x], rep[x], np.stack([about[k][3] for k in x]))
            rows.append((int(part[s]), 0, pack(np.diff(keys[s:e], prepend=np.uint64(0)), a[at[s:e]]), sets))
        return _batch(_SMALL, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, about, count = [], [], 0
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, size, body in zip(*(batch.column(c).to_pylist() for c in ("a", "size", "body"))):
                    delta, df = unpack(body, np.uint64, np.uint32)
                    tok = np.cumsum(delta, dtype=np.uint64)
                    keys = signatures(tok, df, size, t, classes)
                    if len(keys):
                        held.append(keys)
                        about.append((a, size, len(tok), sketch(tok, sketches) if sketches else None))
                        count += len(keys)
                    if count > FLUSH:
                        yield flush(held, about)
                        held, about, count = [], [], 0
        if held:
            yield flush(held, about)

    return run


def _forest(own: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each set with the least one it is connected to."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    moved = np.flatnonzero(label != np.arange(len(own)))
    for s in range(0, len(moved), 50_000):
        x = moved[s : s + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(own[label[x]])], schema=schema)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share a signature, as a forest: each with the least set it is linked to here."""
    held = []
    for batch in batches:
        for body in batch.column("body").to_pylist():
            delta, sig = unpack(body, np.uint64, np.uint64)
            held.append((np.cumsum(delta, dtype=np.uint64), sig))
    if not held:
        return
    keys, sig = map(np.concatenate, zip(*held))
    own, at = np.unique(sig.view(np.int64), return_inverse=True)
    o = np.argsort(keys, kind="stable")
    keys, at = keys[o], at[o]
    b = _bounds(keys)
    head = at[np.repeat(b[:-1], np.diff(b))]
    edge = np.unique(head[head != at] * len(own) + at[head != at])
    yield from _forest(own, local_components(len(own), edge // len(own), edge % len(own)))


def similar_groups(keys: np.ndarray, at: np.ndarray, size: np.ndarray, rep: np.ndarray, bits: np.ndarray, t: float) -> np.ndarray:
    """The least set that each set is connected to, where sets that share a key connect if their sketches allow the threshold.

    Row by row set at[k] has keys[k]; a set has ``size`` tokens, ``rep`` repeated
    ones and the sketch ``bits``.  No pair that reaches the threshold and shares
    a key is left apart; sets too far from each other may be connected.
    """
    n = len(size)
    size, rep = size.astype(np.int64), rep.astype(np.int64)
    step = max(1, AT_ONCE * SKETCH // (64 * bits.shape[1]))

    def allowed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = np.unique(np.minimum(x, y) * n + np.maximum(x, y))
        x, y = code // n, code % n
        ok = np.zeros(len(x), bool)
        for s in range(0, len(x), step):
            i, j = x[s : s + step], y[s : s + step]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
            most = np.minimum((rep[i] + rep[j] - apart) / 2, np.minimum(rep[i], rep[j]))
            ok[s : s + step] = most >= (t - 1e-9) * (size[i] + size[j] - most)
        return x[ok], y[ok]

    # the first of a key with the others, and neighbours by size: that places most of a group of near copies
    o = np.lexsort((at, size[at], keys))
    keys, at = keys[o], at[o]
    b = _bounds(keys)
    same = np.flatnonzero(keys[1:] == keys[:-1])
    label = local_components(n, *allowed(np.concatenate([np.repeat(at[b[:-1]], np.diff(b)), at[same]]), np.concatenate([at, at[same + 1]])))
    # then every pair of a key that is still apart
    o = np.lexsort((label[at], keys))
    keys, at = keys[o], at[o]
    b = _bounds(keys)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (label[at[1:]] != label[at[:-1]])
    r = np.append(np.flatnonzero(new), len(keys))
    after = np.repeat(r[1:], np.diff(r))
    pairs = np.repeat(b[1:], np.diff(b)) - after
    crowd = np.repeat(np.add.reduceat(pairs, b[:-1]) > CROWD, np.diff(b))
    if crowd.any():
        label = local_components(n, np.concatenate([np.arange(n), np.repeat(at[b[:-1]], np.diff(b))[crowd]]), np.concatenate([label, at[crowd]]))
        pairs[crowd] = 0
    rows = np.flatnonzero(pairs)
    ends = np.cumsum(pairs[rows])
    s = 0
    while s < len(rows):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + 20 * AT_ONCE, "right")))
        count = pairs[rows[s:e]]
        i = np.repeat(rows[s:e], count)
        x, y = at[i], at[after[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)]
        least = np.minimum(rep[x], rep[y])
        live = (label[x] != label[y]) & (least >= (t - 1e-9) * (size[x] + size[y] - least))
        x, y = allowed(x[live], y[live])
        if len(x):
            label = local_components(n, np.concatenate([np.arange(n), x]), np.concatenate([label, y]))
        s = e
    return label


def _link_similar(t: float, width: int):
    """As _link, but only sets whose sketches allow the threshold are connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, about = [], []
        for batch in batches:
            for body, sets in zip(batch.column("body").to_pylist(), batch.column("sets").to_pylist()):
                delta, a = unpack(body, np.uint64, np.int64)
                held.append((np.cumsum(delta, dtype=np.uint64), a))
                about.append(unpack(sets, np.int64, np.uint32, np.uint32, np.dtype(f"V{width // 8}")))
        if not held:
            return
        keys, a = map(np.concatenate, zip(*held))
        own, size, rep, bits = map(np.concatenate, zip(*about))
        own, first = np.unique(own, return_index=True)
        bits = bits[first].view(np.uint64).reshape(len(own), -1)
        yield from _forest(own, similar_groups(keys, np.searchsorted(own, a), size[first], rep[first], bits, t))

    return run


#: Sets of one tile: larger groups of candidates are compared tile by tile, on as many tasks.
TILE = 1500
#: Centres of a large group in one round, and rounds at most: what they don't place is compared tile by tile.
CENTRES, ROUNDS = 16, 6
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Common tokens of each of the first ``left`` sets with each set, from bit vectors."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, tok, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = times[tok] > 1
    of, tok = of[many], (np.cumsum(times > 1) - 1)[tok[many]]
    out = np.zeros((left, len(sets)), np.int64)
    if not len(tok):
        return out
    o = np.argsort(tok, kind="stable")
    of, tok = of[o], tok[o]
    wide = 16_384
    for at in range(0, int(tok[-1]) + 1, wide):
        s, e = np.searchsorted(tok, [at, at + wide])
        width = min(wide, int(tok[-1]) + 1 - at)
        here = np.unique(of[s:e])
        row = np.zeros(len(sets), np.int64)
        row[here] = np.arange(len(here))
        bits = np.zeros((len(here), -(-width // 64) * 64), bool)
        bits[row[of[s:e]], tok[s:e] - at] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(int(np.searchsorted(here, left))):
            out[here[i], here[i:]] += np.bitwise_count(packed[i] & packed[i:]).sum(axis=1, dtype=np.int64)
    return out


def _sets(table: pa.Table, rows) -> list[np.ndarray]:
    body = table.column("body").to_pylist()
    return [np.cumsum(unpack(body[k], np.uint64, np.uint32)[0], dtype=np.uint64) for k in rows]


def _compare(t: float):
    """Of the pairs of a tile (or of two, or of a core and others) that reach the threshold: kind 0, how many documents a set is linked to by them; kind 1, a forest of them."""

    def run(key, table):
        core, i, j = (key[k].as_py() for k in (1, 2, 3))
        side = np.asarray(table.column("side"))
        o = np.argsort(side, kind="stable")
        left = int((side == 0).sum())
        ids, docs, size = (np.asarray(table.column(c))[o] for c in ("a", "docs", "size"))
        size = size.astype(np.float64)
        both = overlaps(_sets(table, o), left)
        ok = both / (size[:left, None] + size[None, :] - both) >= t - 1e-9
        if core < 0 and i == j:
            ok &= np.arange(left)[:, None] < np.arange(len(ids))[None, :]
        else:
            ok[:, :left] = False
        x, y = np.nonzero(ok)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, x, docs[y])
        np.add.at(links, y, docs[x])
        label = local_components(len(ids), x, y)
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(moved), np.int32)])
        return pa.Table.from_arrays([pa.array(kind), pa.array(ids[np.concatenate([some, moved])]), pa.array(np.concatenate([links[some], ids[label[moved]]]))], schema=_FOUND)

    return run


def _near_centres(least: float):
    """Which centres of its group each set of a tile is near to."""
    schema = pa.schema([("a", pa.int64()), ("no", pa.int32()), ("c", pa.int64()), ("near", pa.float64())])

    def run(sets: pa.Table, centres: pa.Table) -> pa.Table:
        if not len(sets) or not len(centres):
            return schema.empty_table()
        size = np.concatenate([np.asarray(t.column("size")) for t in (centres, sets)]).astype(np.float64)
        m = len(centres)
        both = overlaps(_sets(centres, range(m)) + _sets(sets, range(len(sets))), m)[:, m:]
        near = both / (size[:m, None] + size[None, m:] - both)
        k, x = np.nonzero(near >= least)
        take = lambda t, c, at: t.column(c).combine_chunks().take(pa.array(at))
        return pa.Table.from_arrays([take(sets, "a", x), take(centres, "no", k), take(centres, "c", k), pa.array(near[k, x])], schema=schema)

    return run


def _parted(big: DataFrame, tiles: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Centres of large groups: (a, no, c, near), the sets that are near to one; (a, no, c), the core each set is of.

    A round takes up to CENTRES sets of each group for centres; each set that is
    within half of 1 - t of one joins the core of the first such.  Rounds end
    when they place less than a tile of sets.
    """
    near, own, rest = None, None, big
    for r in range(ROUNDS):
        first = F.min(F.struct(F.xxhash64("a", F.lit(r)).alias("h"), "a"))
        chosen = rest.where(F.col("tile") < CENTRES).groupBy("component", "tile").agg(first.alias("first")).select("component", (F.col("tile") + r * CENTRES).alias("no"), F.col("first.a").alias("c"))
        bodies = rest.select(F.col("a").alias("c"), F.col("size").alias("c_size"), F.col("body").alias("c_body"))
        centres = chosen.join(bodies, "c").join(tiles, "component").select(F.col("component").alias("of"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("cell"), "no", "c", F.col("c_size").alias("size"), F.col("c_body").alias("body"))
        found = checkpoint(rest.groupBy("component", "tile").cogroup(centres.groupBy("of", "cell")).applyInArrow(_near_centres(1 - 1.5 * (1 - t) - 1e-9), "a long, no int, c long, near double"))
        placed = found.where(F.col("near") >= (1 + t) / 2).groupBy("a").agg(F.min(F.struct("no", "c")).alias("own")).select("a", "own.no", "own.c")
        near, own = (found, placed) if near is None else (near.unionByName(found), own.unionByName(placed))
        if placed.count() < TILE:
            break
        rest = rest.join(placed, "a", "left_anti")
    return near, own


def _tiled(rows: DataFrame, by: str) -> DataFrame:
    """rows (.., a) of groups -> the pairs of tiles (i, j) each row takes part in, and on which side."""
    tiles = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    placed = rows.join(tiles, by).withColumn("tile", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    i, j = F.least("tile", "other"), F.greatest("tile", "other")
    return placed.select(by, F.lit(-1).alias("core"), i.alias("i"), j.alias("j"), ((F.col("tile") == j) & (i < j)).cast("int").alias("side"), "a")


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every document: which others its word n-gram set joins.

    n_links is the number of other documents whose sets reach the threshold
    with its own, copies included; class_id is the least id among the documents
    that links connect it to, directly or through others.  Exact and complete.

    ids are integers.  A row without id gives no row.  A document without text
    or without a word is alone in its class.  A text of 1 to n-1 words is a set
    of one token, equal only to the same words.  Repeated rows of one id count
    once; an id with several texts has the links of all of them, to its own
    others too, and the least of their classes.  An empty table gives an empty
    one.  Other columns are not read.
    """
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("n must be positive and the threshold in (0, 1]")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = text_bytes(own, "text")
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-size // (PIECES * BYTES_EACH)))
    subs = max(1, -(-size // (parts * BYTES_EACH)))
    counted = own.mapInArrow(_spread(n, parts, subs), _ROWS).repartitionById(parts, F.col("part")).mapInArrow(_count(parts, subs), _ROWS)
    items = checkpoint(counted.repartitionById(parts, F.col("part")).mapInArrow(_gather(threshold), "kind int, a long, size int, body binary"))
    del counted  # or its shuffles stay on disk to the end
    members = items.where("kind = 2").mapInArrow(_members, "set long, id long").distinct()
    of_set = members.groupBy("set").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("docs"))
    item = items.where("kind = 0").select("a", "size", "body")
    some = max(2 * spark.sparkContext.defaultParallelism, -(-size // (4 * BYTES_EACH)))
    total = item.count()
    classes = tuple(max(int(share * total), least) for share, least in CLASSES)
    item = item.where("length(body) > 0")
    links = item.mapInArrow(_sign(threshold, some, classes), _ROWS).repartitionById(some, F.col("part")).mapInArrow(_link, "a long, b long")
    groups = components(links).select("component", F.col("node").alias("a"))
    # the bodies of all sets move to their groups once, later only those of large groups
    sets = checkpoint(item.join(of_set.select(F.col("set").alias("a"), "docs"), "a").join(groups, "a"))
    tiles_of = lambda sets: checkpoint(sets.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"), F.sum("size").alias("tokens"), F.max("size").alias("most")).where("tiles > 1"))
    large = tiles_of(sets)
    for width, least, parts in ((SKETCH, 0, some), (WIDE, SKETCH // 2, 0)):
        again = large.where(F.col("most") > least)
        tokens = again.agg(F.sum("tokens")).first()[0]
        if tokens is None:
            continue
        parts = parts or max(2 * spark.sparkContext.defaultParallelism, -(-tokens // WIDE_EACH))
        again = F.broadcast(again.select("component"))  # a row for each TILE sets at most
        loose = sets.join(again, "component", "left_semi").select("a", "size", "body", "docs")
        links = loose.mapInArrow(_sign(threshold, parts, classes, width), _ROWS).repartitionById(parts, F.col("part")).mapInArrow(_link_similar(threshold, width), "a long, b long")
        groups = components(links).select("component", F.col("node").alias("a"))
        sets = checkpoint(sets.join(again, "component", "left_anti").unionByName(loose.join(groups, "a")))
        large = tiles_of(sets)
    large = large.select("component", "tiles")
    sets = sets.join(F.broadcast(large), "component", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int"))
    tiled = sets.where("tiles = 1").select("component", F.lit(-1).alias("core"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "a", "size", "body", "docs")
    certain = None
    if not large.isEmpty():
        big = sets.where("tiles > 1").drop("tiles")
        near, own = _parted(big, large, threshold)
        core = big.select("component", "a", "docs").join(own, "a")
        sums = core.groupBy("component", "no").agg(F.sum("docs").alias("all"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("lefts"))
        core = core.join(sums, ["component", "no"])
        certain = core.select(F.lit(0).alias("kind"), "a", (F.col("all") - F.col("docs")).alias("b")).unionByName(core.where("a <> c").select(F.lit(1).alias("kind"), "a", F.col("c").alias("b")))
        # who may link to a core: sets of later cores, and of none
        others = near.join(own.select("a", F.col("no").alias("of")), "a", "left").where("of is null or of > no").join(big.select("a", "component"), "a").select("component", "no", "a")
        rights = others.groupBy("component", "no").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("rights"))
        cell = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = core.join(rights, ["component", "no"]).withColumn("i", cell("lefts")).withColumn("j", spread("rights")).withColumn("side", F.lit(0))
        right = others.join(rights, ["component", "no"]).join(sums, ["component", "no"]).withColumn("j", cell("rights")).withColumn("i", spread("lefts")).withColumn("side", F.lit(1))
        pick = lambda df: df.select("component", F.col("no").alias("core"), "i", "j", "side", "a")
        rows = _tiled(big.join(own, "a", "left_anti").select("component", "a"), "component").unionByName(pick(left)).unionByName(pick(right))
        tiled = tiled.unionByName(rows.join(big.select("a", "size", "body", "docs"), "a"))
    found = tiled.groupBy("component", "core", "i", "j").applyInArrow(_compare(threshold), "kind int, a long, b long")
    found = checkpoint(found if certain is None else found.unionByName(certain))
    degree = found.where("kind = 0").groupBy(F.col("a").alias("set")).agg(F.sum("b").alias("links"))
    joined = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "set")
    least = joined.join(of_set, "set").groupBy("component").agg(F.min("least").alias("class_id"))
    of_set = of_set.join(degree, "set", "left").join(joined.join(least, "component").select("set", "class_id"), "set", "left")
    of_set = of_set.select("set", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    return members.join(of_set, "set").groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
