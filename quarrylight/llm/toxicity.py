"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.
What a word saves when it is compressed with the toxic dictionary instead of
the ordinary one, less the cost of a chance match, is its gain; the gain of a
window is that of its words together, and a document is toxic if a window's
gain reaches a threshold that is calibrated on labelled documents which the
dictionaries were not trained on.

On a word of ten bytes a frame's fixed cost would hide the difference, so words
and dictionaries are recoded before they meet: each byte becomes four bytes, a
hash of it and the three before.  Literals then cost four bytes each and don't
yield to entropy coding, and a match of the dictionary is four bytes a
character, so gains of a few characters stand out from the frame.

Toxic documents are ordinary text for the most part, and a dictionary trained
on all of it holds what both kinds of text share.  So the toxic dictionary is
trained on the strings of toxic documents that set them apart: those in
significantly more toxic than ordinary documents, and RATIO times as often.
The ordinary one is trained on whole ordinary documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import buffers, fold_bytes, mix, ngrams, pieces, words

#: Labelled documents of either class that training and calibration read at most; one in HELD of them calibrates.
TOXIC_ROWS, ORDINARY_ROWS, HELD = 1500, 3000, 3
#: Characters of each dictionary at most.
DICTIONARY = 16_384
#: Lengths in bytes of the strings that tell toxic text, and how many times more often than in ordinary documents they are in toxic ones.
GRAMS, RATIO = (5, 7, 9), 50.0
#: Words of a window, what a chance match of a word gains, and the share of ordinary documents that may be flagged.
WINDOW, CHANCE, FALSE_ALARMS = 64, 4, 0.005
#: Bytes that the trainer needs at least: fewer are repeated.
_LEAST = 1 << 16
_PAD = b"\0" * 64
_NEVER = 1 << 30


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int


def recode(b: np.ndarray) -> np.ndarray:
    """For each byte from the fourth on, 32 bits that depend on it and the three before."""
    b = b.astype(np.uint32)
    x = b[3:] | (b[2:-1] << 8) | (b[1:-2] << 16) | (b[:-3] << 24)
    with np.errstate(over="ignore"):
        for shift, by in ((15, 0x85EBCA77), (13, 0xC2B2AE3D)):
            x = (x ^ (x >> np.uint32(shift))) * np.uint32(by)
    return x ^ (x >> np.uint32(16))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _layout(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three spaces, a word, a space, and so on; where each word's part begins, and the words' sizes."""
    size = e - s
    start = np.cumsum(size + 4) - (size + 4)
    line = np.full(int(size.sum() + 4 * len(size)) + 3, 32, np.uint8)
    line[np.repeat(start + 3, size) + _runs(np.zeros(len(s), np.int64), size)] = fold_bytes(buf)[_runs(s, size)]
    return line, start, size


def distinct(texts: list[bytes], n: int = 3) -> list[bytes]:
    """Texts of which at most half of the n-grams of words are in those before: a copy would count its words twice."""
    seen: set[int] = set()
    out = []
    for t in texts:
        buf = np.frombuffer(t, np.uint8)
        h = words(buf, np.array([0, len(buf)]))[3]
        g = np.unique(ngrams(h, min(n, len(h)))).tolist() if len(h) else []
        if 2 * sum(x in seen for x in g) < len(g):
            seen.update(g)
            out.append(t)
    return out


class _Line:
    """A text as the trainer sees it."""

    def __init__(self, text: bytes):
        buf = np.frombuffer(text, np.uint8)
        _, s, e, _ = words(buf, np.array([0, len(buf)]))
        self.line, _, size = _layout(buf, s, e)
        self.size = size.astype(np.int32)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of n bytes, and whether it is of one word with its spaces."""
        b = self.line
        x = np.zeros(max(0, len(b) - n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                x = x * np.uint64(0x100000001B3) + b[k : len(b) - n + 1 + k] + np.uint64(1)
        cell = np.append(np.repeat(np.arange(len(self.size), dtype=np.int32), self.size + 4), np.full(3, -1, np.int32))
        return x, (cell[: len(x)] == cell[n - 1 :]) & (cell[: len(x)] >= 0)

    def distinct_grams(self, n: int) -> np.ndarray:
        g, ok = self.grams(n)
        return np.unique(g[ok])


def _telling(toxic: list[_Line], ordinary: list[_Line], n: int) -> np.ndarray:
    """Strings of n bytes that are in significantly more toxic than ordinary documents, and RATIO times as often."""
    gram, count = np.unique(np.concatenate([x.distinct_grams(n) for x in toxic]), return_counts=True)
    tested = len(gram)
    gram, count = gram[count > 1], count[count > 1]
    if not len(gram):
        return gram
    other = np.zeros(len(gram), np.int64)
    for x in ordinary:
        g = x.distinct_grams(n)
        at = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
        other[at[gram[at] == g]] += 1
    p, q = len(toxic) / (len(toxic) + len(ordinary)), count / (count + other)
    with np.errstate(divide="ignore", invalid="ignore"):  # Chernoff's bound for so many of the documents by chance
        odds = q * np.log(q / p) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0)
    rare = count * len(ordinary) >= RATIO * (other + 0.5) * len(toxic)
    return gram[(q > p) & ((count + other) * odds >= math.log(10 * tested)) & rare]


def _dictionary(samples: list[bytes]) -> bytes:
    """What zstandard's trainer makes of the samples, recoded; empty without samples."""
    samples = [x for x in samples if len(x) >= 8]
    if not samples:
        return b""
    times = max(1, -(-_LEAST // sum(map(len, samples))), -(-64 // len(samples)))
    plain = zstandard.train_dictionary(DICTIONARY, samples * times).as_bytes()
    return recode(np.frombuffer(b"   " + plain, np.uint8)).tobytes()


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """From texts of both classes, both by zstandard's trainer; either is empty if there is nothing to train it on."""
    sides = [[_Line(t) for t in side] for side in (toxic, ordinary)]
    samples = []
    if toxic and ordinary:
        on = [np.zeros(len(x.line) + 2, np.int8) for x in sides[0]]
        for n in GRAMS:
            marks = _telling(*sides, n)
            for m, x in zip(on, sides[0]):
                g, ok = x.grams(n)
                hit = np.flatnonzero(np.isin(g, marks) & ok)
                for k in range(n):
                    m[hit + 1 + k] = 1
        for x, m in zip(sides[0], on):
            edge = np.diff(m)
            samples += [b" " * max(0, 8 - (e - s)) + x.line[s:e].tobytes() for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return _dictionary(samples), _dictionary([x.line[i : i + 256].tobytes() for x in sides[1] for i in range(0, len(x.line) - 3, 256)])


class Scorer:
    """Gains of words and windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=14, chain_log=14, search_log=3, min_match=6, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        size = max(len(toxic), len(ordinary), 8)

        def compressor(d: bytes):
            # both of one size, so that equal matches cost the same in either; the filler matches nothing
            filler = mix(np.arange(size // 8 + 1, dtype=np.uint64)).tobytes()
            dictionary = zstandard.ZstdCompressionDict(filler[: size - len(d)] + d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(compression_params=params, dict_data=dictionary)

        self.toxic, self.ordinary = compressor(toxic), compressor(ordinary)
        self.seen: dict[int, int] = {}
        # a match has two codes in sequence (but for a chance of 1 in 65,536): words without two of the toxic dictionary gain nothing and aren't compressed
        self.near = np.zeros(1 << 22, bool)
        self.near[self._pairs(np.frombuffer(toxic, np.uint32))] = True

    @staticmethod
    def _pairs(codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:]) >> np.uint32(10)

    def gain(self, word: bytes) -> int:
        """Of a recoded word."""
        x = word + _PAD
        return max(0, len(self.ordinary.compress(x)) - len(self.toxic.compress(x)) - CHANCE)

    def gains(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Of each word; h: the words' hashes."""
        out = np.zeros(len(h), np.int64)
        line, start, size = _layout(buf, s, e)
        codes = recode(line)
        hits = np.concatenate([[0], np.cumsum(self.near[self._pairs(codes)])])
        live = np.flatnonzero(hits[start + size] > hits[start])
        raw = codes.tobytes()
        for i in live.tolist():
            key = int(h[i])
            g = self.seen.get(key)
            if g is None:
                if len(self.seen) > 500_000:
                    self.seen.clear()
                g = self.seen[key] = self.gain(raw[4 * int(start[i]) : 4 * int(start[i] + size[i] + 1)])
            out[i] = g
        return out

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, list[str | None]]:
        """Of each text the gain of its best window, and the word that gains most (the first of equals)."""
        buf, offs = buffers(texts)
        score, word = np.zeros(len(texts), np.int64), [None] * len(texts)
        d, s, e, h = words(buf, offs)
        if not len(d):
            return score, word
        g = self.gains(buf, s, e, h)
        total = np.concatenate([[0], np.cumsum(g)])
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        at = np.arange(len(d))
        begin = np.maximum(np.repeat(first, np.diff(np.append(first, len(d)))), at - WINDOW + 1)
        score[d[first]] = np.maximum.reduceat(total[1:] - total[begin], first)
        most = np.maximum.reduceat(g, first)
        for k in np.flatnonzero(most > 0):
            i = first[k] + int(np.argmax(g[first[k] : first[k + 1] if k + 1 < len(first) else None]))
            word[d[i]] = bytes(buf[s[i] : e[i]]).decode("utf-8", "replace")
        return score, word


def threshold(toxic: np.ndarray, ordinary: np.ndarray, share: float, false_alarms: float = FALSE_ALARMS) -> int:
    """The score from which a document is toxic, from scores of held-out documents of both classes.

    share: of toxic documents in the corpus.  Of the thresholds that flag at
    most ``false_alarms`` of the ordinary ones, that with the greatest F1 at
    this share; of several with the same the middle one.  If none catches any,
    nothing is toxic.
    """
    if not len(toxic) or not len(ordinary):
        return _NEVER
    t = np.arange(1, int(max(toxic.max(), ordinary.max())) + 2)
    caught, alarms = (np.mean(x[None, :] >= t[:, None], axis=1) for x in (toxic, ordinary))
    f = np.where(alarms <= false_alarms, 2 * share * caught / (share * caught + (1 - share) * alarms + share), 0)
    if f.max() <= 0:
        return _NEVER
    best = t[f >= f.max() - 1e-9]
    return int(best[len(best) // 2])


def train(toxic: list[bytes], ordinary: list[bytes], share: float | None = None) -> Model:
    """Dictionaries from two thirds of the texts, the threshold from the rest, scored with these dictionaries."""
    toxic, ordinary = distinct(toxic), distinct(ordinary)
    held, rest = [side[::HELD] for side in (toxic, ordinary)], [[t for k, t in enumerate(side) if k % HELD] for side in (toxic, ordinary)]
    dictionaries = train_dictionaries(*rest)
    scorer = Scorer(*dictionaries)
    scores = [scorer.rows(pa.array([t.decode("utf-8", "replace") for t in side], pa.string()))[0] for side in held]
    if share is None:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
    return Model(*dictionaries, threshold(*scores, share))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled documents: of each class at most so many, chosen by the hash of the id.

    An id with several labels is toxic if one says so; of several texts of an
    id the least counts.  Rows with a null id, label or text teach nothing.
    Without a document of either class, nothing is ever toxic.
    """
    known = labels.select(F.col(id_col).cast("long").alias("i"), (F.col(label_col) > 0).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    chosen = None
    for y, most in ((True, toxic_rows), (False, ordinary_rows)):
        side = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(most)
        chosen = side if chosen is None else chosen.unionByName(side)
    rows = (
        docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
        .where("t is not null")
        .join(F.broadcast(chosen), "i")  # toxic_rows + ordinary_rows ids at most
        .groupBy("i", "y")
        .agg(F.min("t").alias("t"))
        .orderBy(F.xxhash64("i"), "i")
        .select("y", "t")
        .toArrow()
    )
    sides: dict[bool, list[bytes]] = {True: [], False: []}
    for y, t in zip(rows.column("y").to_pylist(), rows.column("t")):
        sides[y].append(t.as_py().encode())
    return train(sides[True], sides[False], share)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with toxic_score (int), toxic_word and toxic (boolean); such columns are replaced.

    toxic_score is the greatest gain of a window of WINDOW words (a shorter text
    is one window), toxic_word the word that gains most.  Every window of a
    whole text is scored.  A null, empty or wordless text scores 0 and isn't
    toxic.  Repeated rows score alike; an empty table gives an empty one.
    Narrow: no shuffle.
    """
    added = ("toxic_score", "toxic_word", "toxic")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    toxic, ordinary, least = model.toxic, model.ordinary, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(toxic, ordinary)
        for batch in pieces(batches, text_col):
            score, word = scorer.rows(batch.column(text_col))
            names = [*batch.schema.names, *added]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.int32()), pa.array(word, pa.string()), pa.array(score >= least)], names)

    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.IntegerType()), T.StructField("toxic_word", T.StringType()), T.StructField("toxic", T.BooleanType())])
    return docs.mapInArrow(run, schema)
