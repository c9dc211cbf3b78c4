"""Order-preserving packing of documents into windows of fixed length.

Cuts are chosen by dynamic programming over the boundaries of a stream of
documents: best[j] = capacity - (S[j] - S[i]) + penalty[j] + best[i], least over
the i with S[j] - S[i] <= capacity, where S counts tokens.  Written as
S-free minimum of best[i] + S[i] over a window that only moves forward, a
monotone queue gives each transition in constant time.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import id_range
from .textkernel import buffers, words

DOCUMENT, SENTENCE, HARD = 0, 1, 2
KINDS = ("document", "sentence", "hard")
SCHEMA = "shard long, window int, doc_ids array<bigint>, starts array<int>, stops array<int>, text string, n_tokens int, n_padding int, cut string"

_END = np.isin(np.arange(256), list(b".!?"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r"))


def sentence_stops(buf: np.ndarray, end: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Whether a sentence ends after each word: .!? and white space, or a new line, before the next one.

    end: byte after each word; following: first byte of the next word, or the end of the text.
    """
    if not len(buf):
        return np.zeros(0, bool)
    mark = np.concatenate([[0], np.cumsum(_END[buf[:-1]] & _SPACE[buf[1:]]), [0]])
    mark[-1] = mark[-2]
    line = np.concatenate([[0], np.cumsum(buf == 10)])
    return (mark[np.maximum(following - 1, end)] > mark[end]) | (line[following] > line[end])


def best_cuts(size: np.ndarray, kind: np.ndarray, capacity: int, penalties: tuple[float, float, float]) -> list[int]:
    """Boundaries (1..len) after which windows end.  size: tokens of each unit, at most capacity; kind: of the boundary after it.

    Of equal costs the one with the longest windows first wins.
    """
    s, best, back = 0, [0.0], [0]
    total = [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j, (n, k) in enumerate(zip(size.tolist(), kind.tolist()), 1):
        s += n
        total.append(s)
        while total[queue[0][1]] < s - capacity:
            queue.popleft()
        value, i = queue[0]
        cost = capacity - s + penalties[k] + value
        best.append(cost)
        back.append(i)
        value = cost + s
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(size)
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def units(buf, offs, capacity: int):
    """Sentences of all texts in order, as (text, first word, words, kind of the boundary after it); and the words."""
    d, s, e, _ = words(buf, offs)
    if not len(d):
        z = np.zeros(0, np.int64)
        return z, z, z, z, s, e
    last = np.append(d[1:] != d[:-1], True)
    following = np.where(last, offs[d + 1], np.append(s[1:], len(buf)))
    stop = last | sentence_stops(buf, e, following)
    at = np.flatnonzero(stop)
    begin = np.concatenate([[0], at[:-1] + 1])
    size = at + 1 - begin
    pieces = -(-size // capacity)  # a longer sentence is cut hard
    of = np.repeat(np.arange(len(at)), pieces)
    k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    n = np.minimum(capacity, size[of] - k * capacity)
    kind = np.where(k + 1 < pieces[of], HARD, np.where(last[at][of], DOCUMENT, SENTENCE))
    return d[at][of], begin[of] + k * capacity, n, kind, s, e


def _pack(capacity: int, penalties: tuple[float, float, float]):
    schema = pa.schema([("shard", pa.int64()), ("window", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("text", pa.string()), ("n_tokens", pa.int32()), ("n_padding", pa.int32()), ("cut", pa.string())])

    def run(key, table):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        nulls = table.column("id").null_count
        if nulls:  # they sort last; in the order of the corpus they come first
            table = pa.concat_tables([table.slice(len(table) - nulls), table.slice(0, len(table) - nulls)])
        ids = table.column("id").to_pylist()
        buf, offs = buffers(table.column("text"))
        raw = buf.tobytes()
        d, first, n, kind, s, e = units(buf, offs, capacity)
        count = np.bincount(d, weights=n, minlength=len(ids)).astype(np.int64)
        base = np.cumsum(count) - count
        rows, at = [], 0
        for w, cut in enumerate(best_cuts(n, kind, capacity, penalties)):
            parts, tokens = [], int(n[at:cut].sum())
            b = np.flatnonzero(np.concatenate([[True], d[at + 1 : cut] != d[at : cut - 1], [True]])) + at
            for x, y in zip(b[:-1], b[1:]):
                lo, hi, doc = first[x], first[y - 1] + n[y - 1], d[x]
                begin = offs[doc] if lo == base[doc] else s[lo]
                stop = offs[doc + 1] if hi == base[doc] + count[doc] else s[hi]
                parts.append((ids[doc], int(lo - base[doc]), int(hi - base[doc]), raw[begin:stop].decode("utf-8", "replace")))
            rows.append((key[0].as_py(), w, [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], "\n\n".join(p[3] for p in parts), tokens, capacity - tokens, KINDS[kind[cut - 1]]))
            at = cut
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def pack_documents(docs: DataFrame, capacity: int = 2048, sentence_penalty: float = 64.0, hard_penalty: float = 512.0, id_col: str = "doc_id", text_col: str = "text", rows: int = 2048) -> DataFrame:
    """Windows of at most ``capacity`` tokens (words), in the order of ids, that cost least in all.

    A window costs its padding, plus a penalty if it ends inside a document: at
    a sentence boundary, or inside a sentence, which happens only to sentences
    longer than a window.  Least cost is exact within a shard, a range of about
    ``rows`` documents by id; a window never spans shards.

    Columns: shard, window (from 0), doc_ids, starts and stops (words of each
    document in the window), text, n_tokens, n_padding, cut (kind of boundary
    at its end).  Texts are used whole.  Null, empty and wordless texts take
    part in no window.  Rows without id come first, with a null in doc_ids;
    repeated rows are packed each.  An empty table gives no window.  Other
    columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.withColumn("shard", id_range(own, "id", rows)).where("text is not null").groupBy("shard").applyInArrow(_pack(capacity, (0.0, float(sentence_penalty), float(hard_penalty))), SCHEMA)
