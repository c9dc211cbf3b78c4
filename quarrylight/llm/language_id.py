"""Languages of spans in mixed-language text.

A word's script leaves only the languages trained with it; character trigrams
score the word for each of those; Viterbi with a penalty for each switch finds
the best labelling of a text, whose runs are the spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import buffers, fold_bytes, pieces, words

#: Labelled documents of each language that training reads, about.
TRAIN_ROWS = 2000
BUCKETS = 1 << 16
#: Scripts by the code points they start at; letters of ASCII are Latin, digits of no script.
SCRIPTS = [(0, None), (0x41, "Latn"), (0x250, None), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Armn"), (0x590, "Hebr"), (0x600, "Arab"), (0x700, None), (0x900, "Deva"), (0x980, "Beng"), (0xA00, None), (0xB80, "Taml"), (0xC00, None), (0xE00, "Thai"), (0xE80, None), (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Ethi"), (0x1380, None), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2000, None), (0x3040, "Kana"), (0x3100, None), (0x3400, "Hani"), (0xA000, None), (0xAC00, "Hang"), (0xD7B0, None), (0xF900, "Hani"), (0xFB00, None), (0x20000, "Hani"), (0x30000, None)]
NAMES = sorted({s for _, s in SCRIPTS if s})
_STARTS = np.array([c for c, _ in SCRIPTS])
_OF = np.array([NAMES.index(s) if s else -1 for _, s in SCRIPTS])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # BUCKETS x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def scripts(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Script of each word's first letter (-1: none): digits before it don't count."""
    at = s.copy()
    while True:
        digit = np.flatnonzero((at < e - 1) & (buf[np.minimum(at, len(buf) - 1)] < 58))
        if not len(digit):
            break
        at[digit] += 1
    pad = np.concatenate([buf, np.zeros(4, np.uint8)]).astype(np.int64)
    a, b, c, d = (pad[at + k] for k in range(4))
    code = np.where(a < 0x80, np.where(a < 58, 0, 0x41), np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))
    return _OF[np.searchsorted(_STARTS, code, "right") - 1]


def trigrams(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' trigrams, a space on either side counted; where each word's begin."""
    size = e - s
    start = np.cumsum(size) - size
    own = np.repeat(s - start, size) + np.arange(int(size.sum()))
    f = fold_bytes(buf).astype(np.uint32)
    before = np.where(own == np.repeat(s, size), 32, f[np.maximum(own - 1, 0)])
    after = np.where(own == np.repeat(e, size) - 1, 32, f[np.minimum(own + 1, len(f) - 1)])
    with np.errstate(over="ignore"):
        x = (before << 16 | f[own] << 8 | after).astype(np.uint32) * np.uint32(0x9E3779B1)
    return (x >> np.uint32(16)).astype(np.int64), start


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[np.ndarray]] = {}
    for batch in pieces(batches, "text"):
        buf, offs = buffers(batch.column("text"))
        d, s, e, _ = words(buf, offs)
        if not len(d):
            continue
        code, start = trigrams(buf, s, e)
        sc, size = scripts(buf, s, e), e - s
        names = np.array(batch.column("lang").to_pylist())
        for lang in np.unique(names):
            mine = np.flatnonzero(names[d] == lang)
            have = total.setdefault(str(lang), [np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES) + 1, np.int64)])
            have[0] += np.bincount(code[np.repeat(names[d] == lang, size)], minlength=BUCKETS)
            have[1] += np.bincount(sc[mine] + 1, minlength=len(NAMES) + 1)
    schema = pa.schema([("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64())])
    for lang, (c, k) in total.items():
        at = np.flatnonzero(c)
        sc = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + len(sc))), pa.array(np.concatenate([at, -1 - sc]), pa.int32()), pa.array(np.concatenate([c[at], k[sc]]))], schema=schema)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram scores from documents with a language, about ``train_rows`` of each, chosen by the hash of the id."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and lang <> '' and text is not null")
    share = {r["lang"]: min(1.0, train_rows / r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(share))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    limits = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * 1_000_000))])
    rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < limits[F.col("lang")]).select("text", "lang").mapInArrow(_counts, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array([languages.index(x) for x in rows["lang"].to_pylist()], np.int64)
    code, n = np.asarray(rows["code"]), np.asarray(rows["n"]).astype(np.float64)
    counts = np.zeros((BUCKETS, len(languages)))
    by_script = np.zeros((len(NAMES), len(languages)))
    gram = code >= 0
    counts[code[gram], lang[gram]] = n[gram]
    real = code < -1
    by_script[-2 - code[real], lang[real]] = n[real]
    scores = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(languages, scores, by_script >= 0.01 * np.maximum(1, by_script.sum(axis=0)))


def label_words(model: Model, buf: np.ndarray, offs: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, state) of each word; states: the languages, then scripts without one, then no script."""
    d, s, e, _ = words(buf, offs)
    k = len(model.languages)
    if not len(d):
        return d, d
    sc = scripts(buf, s, e)
    code, start = trigrams(buf, s, e)
    score = np.empty((len(d), k), np.float32)
    for j in range(k):
        score[:, j] = np.add.reduceat(model.scores[code, j], start)
    alone = ~model.allowed.any(axis=1) if k else np.ones(len(NAMES), bool)
    used = np.unique(sc[(sc >= 0)])
    extra = [int(x) for x in used if alone[x]]
    none = not k
    states = np.full((len(d), k + len(extra) + none), -1e6, np.float32)
    states[:, :k] = np.where(np.where(sc[:, None] >= 0, model.allowed[sc], True), score, -1e6)
    for j, x in enumerate(extra):
        states[sc == x, k + j] = 0
    states[sc < 0] = 0  # digits and the like belong to whatever is around
    best = _viterbi(states, np.bincount(d, minlength=len(offs) - 1), penalty)
    names = np.array([*range(k), *(k + x for x in extra), *([k + len(NAMES)] if none else [])], np.int64)
    return d, names[best]


def _viterbi(x: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """Best states of all sequences, which stand one after another, in lockstep."""
    first = np.cumsum(length) - length
    o = np.argsort(-length, kind="stable")
    length, first = length[o], first[o]
    n = int((length > 0).sum())
    score = x[first[:n]].copy()
    back = np.zeros(x.shape, np.int8)
    own = np.arange(x.shape[1], dtype=np.int8)
    for t in range(1, int(length[0]) if n else 0):
        m = int(np.searchsorted(-length, -t, "left"))
        a = score[:m]
        top = a.argmax(axis=1)
        high = a[np.arange(m), top][:, None] - np.float32(penalty)
        stay = a >= high
        back[first[:m] + t] = np.where(stay, own, top[:, None].astype(np.int8))
        score[:m] = np.where(stay, a, high) + x[first[:m] + t]
        score[:m] -= score[:m].max(axis=1, keepdims=True)
    out = np.zeros(len(x), np.int64)
    state = score.argmax(axis=1)
    for t in range(int(length[0]) - 1 if n else -1, -1, -1):
        m = int(np.searchsorted(-length, -t, "left"))
        at = first[:m] + t
        out[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return out


def language_spans(docs: DataFrame, model: Model, penalty: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, span, lang, start_word, end_word, n_words): runs of one language in each text, in order.

    Every row has a span at least: a null, empty or wordless text one of 0 words
    with "und".  A script that no trained language uses is "und-" and its name;
    words without letters go with their neighbours.  Whole texts are labelled.
    Rows without id have a null there; repeated rows are labelled each.  Other
    columns are not read.  Narrow: no shuffle.
    """
    names = [*model.languages, *(f"und-{s}" for s in NAMES), "und"]
    schema = pa.schema([("doc_id", pa.int64()), ("span", pa.int32()), ("lang", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("n_words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = np.array(names, object)
        for batch in pieces(batches, "text"):
            d, state = label_words(model, *buffers(batch.column("text")), penalty)
            count = np.bincount(d, minlength=batch.num_rows)
            first = np.cumsum(count) - count
            at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (state[1:] != state[:-1])])) if len(d) else np.zeros(0, np.int64)
            stop = np.append(at[1:], len(d))
            doc = d[at]
            empty = np.flatnonzero(count == 0)
            row = np.concatenate([doc, empty])
            start, end = np.concatenate([at - first[doc], empty * 0]), np.concatenate([stop - first[doc], empty * 0])
            lang = np.concatenate([lookup[state[at]], np.array(["und"] * len(empty), object)])
            o = np.lexsort((start, row))
            row, start, end, lang = row[o], start[o], end[o], lang[o]
            span = np.arange(len(row)) - np.searchsorted(row, row)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(span, pa.int32()), pa.array(lang.tolist(), pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(end - start, pa.int32())], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, span int, lang string, start_word int, end_word int, n_words int")
