"""Repeated passages, found with a compressed FM-index per shard.

Which shard could hold a match is decided by content.  Every run of ``least``
words holds an anchor: the k-gram with the least hash among each
``least - k + 1`` successive ones.  Two occurrences of a passage have the same
anchors, so the surroundings of an anchor that occurs more than once go to the
shard of its hash, as far on either side as a match that has no other anchor
can reach.  Each shard builds FM-indexes over its pieces and streams them
through backward search; the matching statistics that reach the threshold are
the repeated intervals, and their union over shards is exact: it holds every
word of every match of ``least`` words or more, and no other word.

Documents with equal words are indexed once, as the one with the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpoint, pack, partitions, text_bytes, unpack
from .fm_index import FMIndex
from .ngram_join import BYTES_EACH, _batch, _bounds
from .ordering import fresh
from .textkernel import buffers, mix, ngrams, pieces, words

#: Words of an anchor; words of one FM-index (a shard with more has several, and streams through each).
K, INDEX_WORDS = 8, 1_000_000
#: Longer pieces are streamed in stretches of so many words, each with the context a match needs.
STRETCH = 192

_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("body", pa.binary()), ("words", pa.binary())])
_ROWS = "part int, kind int, body binary, words binary"
_FOUND = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("same", pa.int64()), ("pos", pa.int32()), ("anchor", pa.int64())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("earlier", pa.bool_())])


def _text_keys(d: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each text's word sequence, and its length."""
    count = np.bincount(d, minlength=rows)
    start = np.cumsum(count) - count
    key = np.zeros(rows, np.uint64)
    with np.errstate(over="ignore"):
        place = (np.arange(len(h)) - start[d]).astype(np.uint64)
        np.add.at(key, d, mix(h + mix(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))))
    return mix(key + count.astype(np.uint64)), count


def _anchors(d: np.ndarray, h: np.ndarray, least: int, most: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of each anchor.  More than ``most`` words are read in blocks that share least - 1 words."""
    if len(h) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = [at + _block_anchors(d[at : at + most + least - 1], h[at : at + most + least - 1], least) for at in range(0, len(h) - least + 1, most)]
    at = np.unique(np.concatenate(found))
    return at, ngrams(h, K)[at]


def _block_anchors(d: np.ndarray, h: np.ndarray, least: int) -> np.ndarray:
    g = ngrams(h, K)
    w = least - K + 1
    order = np.uint64((1 << 24) - 1)
    x = (g & ~order) | (np.arange(len(g), dtype=np.uint64) & order)
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    if size < w:
        x = np.minimum(x[: len(x) - (w - size)], x[w - size :])
    whole = d[: len(x)] == d[least - 1 : least - 1 + len(x)]
    return np.unique((x[whole] & order).astype(np.int64))


def _find(least: int, parts: int):
    """Kind 0: anchors with document and place, by anchor; kind 1: documents by their word sequence."""

    def flush(held) -> pa.RecordBatch:
        anchor, same, ids, pos, dkey, dids, dlen = (np.concatenate(x) for x in zip(*held))
        rows = []
        part = (anchor % np.uint64(parts)).astype(np.int64)
        o = np.lexsort((anchor, part))
        anchor, same, ids, pos, part = anchor[o], same[o], ids[o], pos[o], part[o]
        b = _bounds(part)
        rows += [(int(part[s]), 0, pack(np.diff(anchor[s:e], prepend=np.uint64(0)), same[s:e], ids[s:e], pos[s:e].astype(np.uint32)), None) for s, e in zip(b[:-1], b[1:])]
        part = (dkey % np.uint64(parts)).astype(np.int64)
        o = np.argsort(part)
        dkey, dids, dlen, part = dkey[o], dids[o], dlen[o], part[o]
        b = _bounds(part)
        rows += [(int(part[s]), 1, pack(dkey[s:e], dids[s:e], dlen[s:e].astype(np.uint32)), None) for s, e in zip(b[:-1], b[1:])]
        return _batch(_PACKED, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in pieces(batches, "text"):
            d, _, _, h = words(*buffers(batch.column("text")))
            key, length = _text_keys(d, h, batch.num_rows)
            ids = np.asarray(batch.column("id"))
            at, anchor = _anchors(d, h, least)
            start = np.cumsum(length) - length
            long = length >= least
            held.append((anchor, key[d[at]], ids[d[at]], at - start[d[at]], key[long], ids[long], length[long]))
            count += len(at)
            if count > 200_000:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: anchors that occur more than once; kind 1 (pos: words) and 2 (the first): documents of equal words."""
    held, docs = [], []
    for batch in batches:
        for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
            if kind:
                docs.append(unpack(body, np.uint64, np.int64, np.uint32))
            else:
                delta, same, ids, pos = unpack(body, np.uint64, np.uint64, np.int64, np.uint32)
                held.append((np.cumsum(delta, dtype=np.uint64), same, ids, pos))

    def rows(kind, doc, same, pos, anchor):
        for s in range(0, len(doc), 50_000):
            x = slice(s, s + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(kind[x], pa.int32()), pa.array(doc[x]), pa.array(same[x].view(np.int64)), pa.array(pos[x], pa.int32()), pa.array(anchor[x].view(np.int64))], schema=_FOUND)

    if docs:
        key, ids, length = map(np.concatenate, zip(*docs))
        o = np.lexsort((ids, key))
        key, ids, length = key[o], ids[o], length[o]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids, length = key[new], ids[new], length[new]
        b = _bounds(key)
        n = np.repeat(np.diff(b), np.diff(b))
        kind = np.ones(len(key), np.int64)
        kind[b[:-1]] = 2
        many = n > 1
        yield from rows(kind[many], ids[many], key[many], length[many].astype(np.int64), np.zeros(int(many.sum()), np.uint64))
    if held:
        anchor, same, ids, pos = map(np.concatenate, zip(*held))
        o = np.lexsort((ids, pos, same, anchor))
        anchor, same, ids, pos = anchor[o], same[o], ids[o], pos[o]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (same[1:] != same[:-1]) | (pos[1:] != pos[:-1])
        anchor, same, ids, pos = anchor[new], same[new], ids[new], pos[new]
        b = _bounds(anchor)
        many = np.repeat(np.diff(b) > 1, np.diff(b))
        yield from rows(np.zeros(int(many.sum()), np.int64), ids[many], same[many], pos[many].astype(np.int64), anchor[many])


def _cut(least: int, shards: int):
    """Pieces around repeated anchors, by shard; those of a document that overlap in a shard are one."""

    def flush(held, doc, start, length, shard) -> pa.RecordBatch:
        shard, doc, start, length = np.array(shard), np.array(doc, np.int64), np.array(start, np.uint32), np.array(length, np.uint32)
        rows = []
        o = np.argsort(shard, kind="stable")
        b = _bounds(shard[o])
        for s, e in zip(b[:-1], b[1:]):
            x = o[s:e]
            rows.append((int(shard[x[0]]), 0, pack(doc[x], start[x], length[x]), pack(np.concatenate([held[i] for i in x]))))
        return _batch(_PACKED, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, doc, start, length, shard, count = [], [], [], [], [], 0
        for batch in pieces(batches, "text"):
            d, _, _, h = words(*buffers(batch.column("text")))
            key, n = _text_keys(d, h, batch.num_rows)
            first = np.cumsum(n) - n
            ids, same = batch.column("id").to_pylist(), np.asarray(batch.column("same")).view(np.uint64)
            seen = set()
            for i, at in enumerate(batch.column("at")):
                if key[i] != same[i] or (ids[i], same[i]) in seen:
                    continue  # another row of the same id
                seen.add((ids[i], same[i]))
                at = at.values
                pos = np.asarray(at.field("pos")).astype(np.int64)
                to = (np.asarray(at.field("anchor")).view(np.uint64) // np.uint64(7) % np.uint64(shards)).astype(np.int64)
                o = np.lexsort((pos, to))
                pos, to = pos[o], to[o]
                s, e = np.maximum(0, pos - (least - K + 1)), np.minimum(n[i], pos + least + 1)
                new = np.ones(len(s), bool)
                new[1:] = (to[1:] != to[:-1]) | (s[1:] > e[:-1])
                b = np.flatnonzero(np.concatenate([new, [True]]))
                for x, y in zip(b[:-1], b[1:]):
                    piece = h[first[i] + s[x] : first[i] + e[y - 1]]
                    held.append(piece)
                    doc.append(ids[i])
                    start.append(s[x])
                    length.append(len(piece))
                    shard.append(to[x])
                    count += len(piece)
            if count > 1_500_000:
                yield flush(held, doc, start, length, shard)
                held, doc, start, length, shard, count = [], [], [], [], [], 0
        if held:
            yield flush(held, doc, start, length, shard)

    return run


def _search(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for body, text in zip(batch.column("body").to_pylist(), batch.column("words").to_pylist()):
                held.append((*unpack(body, np.int64, np.uint32, np.uint32), unpack(text, np.uint64)[0]))
        if held:
            for doc, start, stop, earlier in repeats(*map(np.concatenate, zip(*held)), least):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(earlier)], schema=_SPANS)

    return run


def repeats(doc, start, length, text, least: int, index_words: int = INDEX_WORDS):
    """Intervals (document, start, stop, occurs before) of one shard's pieces, piece by piece."""
    length = length.astype(np.int64)
    first = np.cumsum(length) - length
    with np.errstate(over="ignore"):
        place = (np.arange(len(text)) - np.repeat(first, length)).astype(np.uint64)
        key = np.add.reduceat(mix(text + mix(place + np.uint64(1))), first) + length.astype(np.uint64)
    o = np.lexsort((start, doc, key))
    b = _bounds(key[o])
    lead, times = o[b[:-1]], np.diff(b)
    group = np.empty(len(doc), np.int64)
    group[o] = np.repeat(np.arange(len(lead)), times)
    s = np.lexsort((start[lead], doc[lead]))  # in the order of the corpus
    place = np.empty(len(s), np.int64)
    place[s] = np.arange(len(s))
    lead, times, group = lead[s], times[s], place[group]
    n = length[lead]
    ends = np.cumsum(n)
    take = np.repeat(first[lead] - (ends - n), n) + np.arange(int(ends[-1]))
    vocabulary, symbols = np.unique(text[take], return_inverse=True)
    frequent = np.bincount(symbols, weights=np.repeat(times, n)) > 1
    symbols = np.where(frequent, np.cumsum(frequent), 0)[symbols]
    own = np.arange(len(symbols)) + np.repeat(np.arange(len(n)), n)
    block = (ends - n) // index_words
    found = []
    for k in np.unique(block):
        inside = np.flatnonzero(block == k)
        lo, hi = int(ends[inside[0]] - n[inside[0]]), int(ends[inside[-1]])
        used = np.unique(symbols[lo:hi])
        used = used[used > 0]
        if not len(used):
            continue
        to = np.full(int(symbols.max()) + 1, 0, np.int64)
        to[used] = np.arange(1, len(used) + 1)
        # words that occur once match nothing: each index gives them a symbol no query has
        inner = to[symbols[lo:hi]]
        index = FMIndex(np.where(inner == 0, len(used) + 1, inner), n[inside], times[inside])
        base = lo + int(inside[0])
        for these, at_least in ((inside, 2), (np.flatnonzero(block != k), 1)):
            if len(these):
                many = -(-n[these] // STRETCH)
                piece = np.repeat(these, many)
                begin = (ends - n)[piece] + (np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
                found.append(index.matches(to[symbols], begin, np.minimum(ends[piece], begin + STRETCH + least), least, at_least, own - base))
    at, q, before = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    piece = np.searchsorted(ends, at, "right")
    off = at - (ends - n)[piece]
    spans = []
    for reach, flag in ((q, False), (before, True)):
        ok = reach > 0
        p, a, z = piece[ok], off[ok], (off + reach)[ok]
        o = np.lexsort((a, p))
        p, a, z = p[o], a[o], z[o]
        if not len(p):
            continue
        far = np.maximum.accumulate(z + p * (1 << 40)) - p * (1 << 40)
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] > far[:-1])])
        begin = np.flatnonzero(new)
        spans.append((p[begin], a[begin], far[np.concatenate([begin[1:], [len(p)]]) - 1], np.full(len(begin), flag)))
    again = np.ones(len(doc), bool)
    again[lead] = False
    x = np.flatnonzero(again)  # the same piece elsewhere, later: all of it occurs before
    for flag in (False, True):
        yield doc[x], start[x].astype(np.int64), (start[x] + length[x]), np.full(len(x), flag)
    for p, a, z, flag in spans:
        yield doc[lead[p]], start[lead[p]] + a, start[lead[p]] + z, flag
    whole = lead[times > 1]
    yield doc[whole], start[whole].astype(np.int64), start[whole] + length[whole], np.full(len(whole), False)


def _union(spans: DataFrame) -> DataFrame:
    """Intervals that overlap or touch become one."""
    w = Window.partitionBy("doc_id", "earlier").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return (
        spans.withColumn("new", new)
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "earlier", "island")
        .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"))
        .drop("island")
    )


def repeated_spans(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Intervals of words that occur elsewhere too, in matches of ``least`` words or more.

    Columns: doc_id, earlier, start_word, end_word (past the last), n_words.
    Rows with earlier = false cover what occurs again anywhere, in the same
    document too; those with earlier = true what has an occurrence before, by
    (doc_id, place).  Removing the latter leaves one copy of every passage.

    Words are compared without case and punctuation.  A row without id, text or
    words has no interval.  Repeated rows of one id count as one; of several
    texts under one id, each is compared and the intervals are united.  Long
    texts are read whole.  An empty table has no interval.  Other columns are not
    read.
    """
    if least < K:
        raise ValueError(f"least must be {K} or more")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    parts = partitions(spark, text_bytes(own, "text"), BYTES_EACH)
    found = checkpoint(own.mapInArrow(_find(least, parts), _ROWS).repartitionById(parts, F.col("part")).mapInArrow(_repeated, "kind int, doc long, same long, pos int, anchor long"))
    anchors = found.where("kind = 0")
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-anchors.count() * least // (2 * INDEX_WORDS)))
    places = anchors.groupBy("doc", "same").agg(F.collect_list(F.struct("pos", "anchor")).alias("at"))
    cut = own.join(places, own.id == places.doc).select("id", "text", "same", "at").mapInArrow(_cut(least, shards), _ROWS)
    spans = cut.repartitionById(shards, F.col("part")).mapInArrow(_search(least), "doc_id long, start int, stop int, earlier boolean")
    copies = found.where("kind > 0").select(
        F.col("doc").alias("doc_id"), F.lit(0).alias("start"), F.col("pos").alias("stop"), F.explode(F.when(F.col("kind") == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("earlier")
    )
    return _union(spans.unionByName(copies)).withColumn("n_words", F.col("end_word") - F.col("start_word"))


def _remove(names: list[str], text_col: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            buf, offs = buffers(batch.column(text_col))
            d, s, e, _ = words(buf, offs)
            count = np.bincount(d, minlength=batch.num_rows)
            first = np.cumsum(count) - count
            raw, out, keep = buf.tobytes(), [], []
            for i, spans in enumerate(batch.column(spans_col).to_pylist()):
                if spans is None:
                    out.append(batch.column(text_col)[i].as_py())
                    keep.append(True)
                    continue
                cut, left, at = [], 0, int(offs[i])
                for a, b in sorted((x["start_word"], x["end_word"]) for x in spans):
                    b = min(b, int(count[i]))
                    if a >= b:
                        continue
                    cut.append(raw[at : s[first[i] + a]])
                    at = int(s[first[i] + b]) if b < count[i] else int(offs[i + 1])
                    left += b - a
                cut.append(raw[at : offs[i + 1]])
                out.append(b"".join(cut).decode("utf-8", "replace").rstrip() if left else raw[offs[i] : offs[i + 1]].decode("utf-8", "replace"))
                keep.append(left < count[i] or not left)
            cols = [pa.array(out, f.type) if f.name == text_col else batch.column(f.name) for f in batch.schema if f.name in names]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in batch.schema if f.name in names]).filter(pa.array(keep, pa.bool_()))

    return run


def remove_repeats(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without the passages that occur before, so that one copy of each stays.

    Of a row that loses words, the text and, if there is one, ``length_col`` are
    new; a row that loses all its words goes.  Rows without id, text or words
    stay as they are.  Every row of a repeated id loses the intervals of that id,
    and of equal rows of one id all stay.  An empty table gives an empty one.
    Other columns stay, whatever their names.
    """
    i, at = fresh(docs, "r_id", "r_spans")
    spans = repeated_spans(docs, least, id_col, text_col).where("earlier").groupBy(F.col("doc_id").alias(i)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(at))
    names = docs.columns
    cut = docs.join(spans, F.col(id_col).cast("long") == F.col(i), "left").drop(i)
    out = cut.mapInArrow(_remove(names, text_col, at), docs.schema)
    if length_col in names:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col).cast(docs.schema[length_col].dataType), length_col))
    return out
