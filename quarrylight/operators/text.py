"""Full-text search: BM25 over two fields, boolean queries, phrases and prefixes.

Two plans with the same scores.  ``keyword_search`` scans the chunks: one
aggregate for document frequencies and mean lengths, then scores as column
arithmetic, for tables without an index.  ``TextIndex`` is a postings table,
built once and kept in runs sorted by term, of which a query reads its own words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPLITTERS, TOKENIZERS, any_of, tokens, words_of
from ..model import GID

FIELDS = ("text", "heading")


class QueryError(ValueError):
    """A query string that can't be read."""


@dataclass
class Node:
    """Of a query: op is term, phrase, prefix, and, or, not, all."""

    op: str
    words: list[str] = field(default_factory=list)
    slop: int = 0
    only: str | None = None
    parts: list[Node] = field(default_factory=list)


_LEX = re.compile(r'\s*(?:(?P<paren>[()])|(?P<sign>[+-])(?=\S)|(?P<field>text|heading):(?=\S)|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?|(?P<word>[^\s()"]+))')


def parse_query(text: str) -> Node:
    """Words (or'ed), "phrases"~slop, + and -, AND, OR, NOT, field: and parentheses; a last word may end in *."""
    text = text.strip()
    if not text:
        return Node("all")
    lexed, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected {text[at:]!r}")
        lexed.append(m)
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    root, rest = _sequence(lexed, 0, 0)
    if rest != len(lexed):
        raise QueryError("unbalanced )")
    return root


def _sequence(lexed: list, i: int, depth: int) -> tuple[Node, int]:
    must, may, none = [], [], []
    pending = ""
    previous = may
    while i < len(lexed):
        m = lexed[i]
        if m["paren"] == ")":
            if not depth:
                raise QueryError("unbalanced )")
            break
        if m["word"] in ("AND", "OR", "NOT"):
            if m["word"] == "AND" and previous is may and may:
                must.append(may.pop())
            pending = m["word"]
            i += 1
            continue
        sign = ""
        if m["sign"]:
            sign, i = m["sign"], i + 1
            if i == len(lexed):
                raise QueryError("nothing after " + sign)
        node, i = _unit(lexed, i, depth)
        if node is None:
            pending = ""
            continue
        to = none if sign == "-" or pending == "NOT" else must if sign == "+" or pending == "AND" else may
        to.append(node)
        previous, pending = to, ""
    if pending:
        raise QueryError("nothing after " + pending)
    if not (must or may) and none:
        must.append(Node("all"))
    if must:
        parts = must + [Node("not", parts=[n]) for n in none]
        # optional parts only add to the score
        return (Node("and", parts=parts + [Node("maybe", parts=may)] if may else parts) if len(parts) > 1 or may else parts[0]), i
    some = Node("or", parts=may) if len(may) != 1 else may[0]
    return (Node("and", parts=[some] + [Node("not", parts=[n]) for n in none]) if none else some), i


def _unit(lexed: list, i: int, depth: int) -> tuple[Node | None, int]:
    m, only = lexed[i], None
    if m["field"]:
        only, i = m["field"], i + 1
        if i == len(lexed):
            raise QueryError("nothing after " + only)
        m = lexed[i]
    if m["paren"] == "(":
        node, i = _sequence(lexed, i + 1, depth + 1)
        if i == len(lexed):
            raise QueryError("missing )")
        return node, i + 1
    if m["phrase"] is not None:
        found = re.findall(r"[^\W_]+", m["phrase"].lower())
        return (Node("phrase" if len(found) > 1 else "term", found, int(m["slop"] or 0), only) if found else None), i + 1
    if m["word"] is None:
        raise QueryError("unexpected sign")
    w = m["word"]
    if w.endswith("*") and len(w) > 1 and i == len(lexed) - 1 and not any(x["phrase"] is not None for x in lexed):
        return Node("prefix", [w[:-1].lower()], only=only), i + 1
    found = words_of(w)
    return (Node("or", parts=[Node("term", [x], only=only) for x in found]) if len(found) > 1 else Node("term", found, only=only) if found else None), i + 1


def _columns(only: str | None) -> list[str]:
    return [f"{only}_tokens"] if only else [f"{f}_tokens" for f in FIELDS]


def _near(column: str, words: list[str], slop: int) -> Column:
    """The words in this order, with at most ``slop`` others between them."""
    if not slop:
        return F.contains(F.concat(F.lit(" "), F.array_join(column, " "), F.lit(" ")), F.lit(" " + " ".join(words) + " "))
    places = F.transform(F.col(column), lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def of(word: str) -> Column:
        return F.transform(F.filter(places, lambda p: p["t"] == word), lambda p: p["i"])

    def following(at: Column, word: str) -> Column:
        return F.array_min(F.filter(of(word), lambda x: x > at))

    def last(start: Column) -> Column:
        return reduce(following, words[1:], start)

    return F.exists(of(words[0]), lambda s: F.coalesce(last(s) - s - (len(words) - 1) <= slop, F.lit(False)))


def matches(node: Node) -> Column:
    """Whether a chunk with text_tokens and heading_tokens matches."""
    if node.op in ("all", "maybe"):
        return F.lit(True)
    if node.op == "term":
        return any_of([F.array_contains(c, node.words[0]) for c in _columns(node.only)])
    if node.op == "phrase":
        return any_of([_near(c, node.words, node.slop) for c in _columns(node.only)])
    if node.op == "prefix":
        return any_of([F.exists(c, lambda t: t.startswith(node.words[0])) for c in _columns(node.only)])
    if node.op == "not":
        return ~matches(node.parts[0])
    if node.op == "or":
        # all single words in one test of a field: a filter doesn't share its parts, and tokens are dear
        words: dict[str, list[str]] = {}
        for p in node.parts:
            if p.op == "term":
                for c in _columns(p.only):
                    words.setdefault(c, []).append(p.words[0])
        some = [F.arrays_overlap(c, F.array(*[F.lit(w) for w in ws])) for c, ws in words.items()]
        return any_of(some + [matches(p) for p in node.parts if p.op != "term"])
    return reduce(lambda a, b: a & b, [matches(p) for p in node.parts])


def scored(node: Node) -> tuple[set[tuple[str, str]], list[Node]]:
    """(field, term) pairs that add to the score, and prefixes, which add 1 each."""
    if node.op in ("term", "phrase"):
        return {(f, w) for f in ([node.only] if node.only else FIELDS) for w in node.words}, []
    if node.op == "prefix":
        return set(), [node]
    if node.op == "not":
        return set(), []
    pairs, prefixes = set(), []
    for p in node.parts:
        a, b = scored(p)
        pairs |= a
        prefixes += b
    return pairs, prefixes


def with_tokens(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"text_tokens": tokens(F.col("text")), "heading_tokens": tokens(F.array_join("heading_path", " "))})


def _contribution(tf: Column, size: Column, idf: Column, mean: Column, boost: Column, k1: float, b: float) -> Column:
    return boost * idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * size / mean))


def _count_of(column: str, word: str) -> Column:
    return F.size(F.filter(column, lambda t: t == word)).cast("double")


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def keyword_search(chunks: DataFrame, query: str | Node, where: Column | None = None, k1: float = 1.2, b: float = 0.75, text_boost: float = 1.0, heading_boost: float = 2.0) -> DataFrame:
    """(gid, bm25) and the columns of the chunks that match; statistics are of all searchable chunks, whatever ``where`` is.

    A blank query matches everything with score 1; a word counts once however
    often the query has it.
    """
    node = parse_query(query) if isinstance(query, str) else query
    index = with_tokens(chunks.where("searchable"))
    terms, prefixes = scored(node)
    rows = index.where(F.lit(True) if where is None else where).where(matches(node))
    if node.op == "all":
        return rows.withColumn("bm25", F.lit(1.0)).drop("text_tokens", "heading_tokens")
    score, boosts = F.lit(0.0), {"text": text_boost, "heading": heading_boost}
    order = sorted(terms)
    if order:
        stats = index.agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.size(f"{f}_tokens")).alias(f"all_{f}") for f in FIELDS], *[F.count(F.when(F.array_contains(f"{f}_tokens", w), 1)).alias(f"df{i}") for i, (f, w) in enumerate(order)]
        ).first()
        n = float(stats["n"])
        for i, (f, w) in enumerate(order):
            if not stats[f"df{i}"]:
                continue
            tf = _count_of(f"{f}_tokens", w)
            mean = max((stats[f"all_{f}"] or 0) / max(n, 1.0), 1.0)
            score = score + _contribution(tf, F.size(f"{f}_tokens").cast("double"), idf(F.lit(n), F.lit(float(stats[f"df{i}"]))), F.lit(mean), F.lit(float(boosts[f])), k1, b)
    for p in prefixes:
        score = score + F.when(matches(p), 1.0).otherwise(0.0)
    return rows.withColumn("bm25", score).drop("text_tokens", "heading_tokens")


def leaves(node: Node) -> list[Node]:
    """Terms, phrases and prefixes of a query, those under a not included."""
    return [node] if node.op in ("term", "phrase", "prefix") else [x for p in node.parts for x in leaves(p)]


def _holds(node: Node, leaf) -> Column | bool:
    """The query as a condition, from what ``leaf`` makes of its leaves."""
    if node.op in ("all", "maybe"):
        return F.lit(True)
    if node.op == "not":
        return ~_holds(node.parts[0], leaf)
    if node.op in ("and", "or"):
        parts = [_holds(p, leaf) for p in node.parts]
        return reduce(lambda a, b: a & b, parts) if node.op == "and" else any_of(parts)
    return leaf(node)


def matches_nothing_known(node: Node) -> bool:
    """Whether a chunk without any word of the query matches it."""
    if node.op in ("all", "maybe"):
        return True
    if node.op == "not":
        return not matches_nothing_known(node.parts[0])
    if node.op in ("and", "or"):
        return (all if node.op == "and" else any)(matches_nothing_known(p) for p in node.parts)
    return False


def _within(places: list[Column], slop: int) -> Column:
    """Whether positions of the words follow each other, with at most ``slop`` other words between them."""
    last = lambda start: reduce(lambda at, p: F.array_min(F.filter(p, lambda x: x > at)), places[1:], start)
    return F.coalesce(F.exists(places[0], lambda s: F.coalesce(last(s) - s - (len(places) - 1) <= slop, F.lit(False))), F.lit(False))


POSTINGS = "term string, field string, collection string, doc_id string, chunk_id long, tf int, dl int, positions array<int>"
#: Tokens of the chunks whose postings are sorted together.
RUN = 2_000_000


def _run(chunks: pa.Table) -> Iterator[pa.RecordBatch]:
    """The postings of some chunks, of each field sorted by term and chunk."""
    for f in FIELDS:
        lists = chunks[f"{f}_tokens"].combine_chunks()
        dl, words = pc.list_value_length(lists), lists.flatten()
        size = dl.to_numpy()
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        pos = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key = np.sort(rank[coded.indices.to_numpy()] << 32 | np.arange(len(row)))
        at, term = key & (1 << 32) - 1, key >> 32
        row = row[at]
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, int)
        ends = np.append(first, len(row)).astype(np.int32)
        of = pa.array(row[first])
        out = pa.RecordBatch.from_arrays(
            [
                coded.dictionary.take(pa.array(order[term[first]])), pa.array([f]).take(pa.array(np.zeros(len(first), np.int8))), *(chunks[c].combine_chunks().take(of) for c in GID),
                pa.array(np.diff(ends)), dl.take(of), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[at])),
            ],
            ["term", "field", *GID, "tf", "dl", "positions"],
        )
        for i in range(0, len(out), 100_000):
            yield out.slice(i, 100_000)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of chunks with tokens, in runs: a word is in few pages of each, and no task sorts more than a run."""
    held, tokens_held = [], 0
    for b in batches:
        done = np.cumsum(sum(pc.list_value_length(b[f"{f}_tokens"]).to_numpy().astype(np.int64) for f in FIELDS))
        start = 0
        while start < len(b):
            before = done[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(done, before + RUN - tokens_held, "right")))
            held.append(b.slice(start, end - start))
            tokens_held += int(done[end - 1] - before)
            start = end
            if start < len(b) or tokens_held >= RUN:
                yield from _run(pa.Table.from_batches(held))
                held, tokens_held = [], 0
    if held:
        yield from _run(pa.Table.from_batches(held))


def _best_of_block(k: int, step: int = 512):
    """The k best (and ties) of a block of chunks for each query of a block, from the parts of the chunks' scores."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        coded = lambda c: c.combine_chunks().dictionary_encode(null_encoding="encode")
        terms, asked = coded(left["term"]), coded(right["query_id"])
        at = pc.index_in(right["term"].combine_chunks(), value_set=terms.dictionary)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        names = [*GID, "bm25"]
        if not known.any():
            return pa.Table.from_arrays([right["query_id"].slice(0, 0), *(left[c].slice(0, 0) for c in GID), pa.array([], pa.float64())], ["query_id", *names])
        weight = np.zeros((len(terms.dictionary), len(asked.dictionary)))
        np.add.at(weight, (at.drop_null().to_numpy(), asked.indices.to_numpy()[known]), 1.0)
        key = np.zeros(len(left), np.int64)
        for c in GID:
            code = coded(left[c])
            key = np.unique(key * len(code.dictionary) + code.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(key, kind="stable")
        key, term, part = key[order], terms.indices.to_numpy()[order], left["part"].to_numpy()[order]
        first = np.searchsorted(key, np.arange(key[-1] + 1))
        scores = np.full((len(first), weight.shape[1]), -np.inf)
        for s in range(0, len(first), step):
            e = min(s + step, len(first))
            rows = slice(first[s], first[e] if e < len(first) else len(key))
            place, size = (key[rows] - s) * len(weight) + term[rows], (e - s) * len(weight)
            score = np.bincount(place, part[rows], size).reshape(e - s, -1) @ weight
            # a word may add nothing
            hit = score > 0 if part.min() > 0 else np.bincount(place, minlength=size).reshape(e - s, -1).astype(float) @ weight > 0
            scores[s:e] = np.where(hit, score, -np.inf)
        least = np.partition(scores, -min(k, len(scores)), axis=0)[-min(k, len(scores))]
        i, j = np.nonzero((scores >= least - 2e-9) & (scores > -np.inf))
        of = pa.array(order[first[i]])
        return pa.Table.from_arrays([asked.dictionary.take(pa.array(j)), *(left[c].take(of) for c in GID), pa.array(scores[i, j])], ["query_id", *names])

    return run


class TextIndex:
    """Postings, document frequencies and mean lengths as tables; rebuildable from the chunks at any time."""

    def __init__(self, postings: DataFrame, stats: DataFrame, frequencies: DataFrame | None = None, tokenizer: str = "default"):
        self.postings, self.stats, self.tokenizer = postings, stats, tokenizer
        self.frequencies = frequencies if frequencies is not None else postings.groupBy("term", "field").agg(F.count(F.lit(1)).cast("double").alias("df"))

    @classmethod
    def build(cls, chunks: DataFrame, tokenizer: str = "default") -> TextIndex:
        """postings(term, field, gid, tf, dl, positions); stats(field, n, mean); frequencies(term, field, df)."""
        split = TOKENIZERS[tokenizer]
        have = chunks.where("searchable")
        tokenized = lambda rows: rows.select(*GID, split(F.col("text")).alias("text_tokens"), split(F.array_join("heading_path", " ")).alias("heading_tokens"))
        index = tokenized(have)
        fields = lambda rows: rows.select(*GID, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_tokens").alias("tokens")) for f in FIELDS])).alias("x")).select(*GID, "x.field", "x.tokens")
        again = have.groupBy(*[F.col(c).alias(f"again_{c}") for c in GID]).count().where("count > 1").drop("count")
        if again.isEmpty():
            postings = index.mapInArrow(_runs, POSTINGS)
        else:
            # only the chunks of an identifier that rows share have to meet
            shared = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"again_{c}")) for c in GID])
            merged = (
                fields(tokenized(have.join(again, shared, "left_semi"))).select(*GID, "field", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
                .groupBy("term", "field", *GID)
                .agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
            )
            postings = tokenized(have.join(again, shared, "left_anti")).mapInArrow(_runs, POSTINGS).unionByName(merged)
        by_field = fields(index)
        stats = by_field.groupBy("field").agg(F.count(F.lit(1)).cast("double").alias("n"), F.greatest(F.sum(F.size("tokens")) / F.count(F.lit(1)), F.lit(1.0)).alias("mean"))
        return cls(postings, stats, tokenizer=tokenizer)

    def save(self, path: str, partitions: int = 32) -> None:
        """Postings as the tasks make them, in runs sorted by term, so that readers skip pages that a query doesn't ask for and nothing is shuffled; frequencies, counted from the postings as written, in an eighth of ``partitions``."""
        spark = self.postings.sparkSession
        # deltas of ascending identifiers and positions take a fraction of the plain numbers
        self.postings.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2").parquet(f"{path}/postings")
        counted = spark.read.parquet(f"{path}/postings").groupBy("term", "field").agg(F.count(F.lit(1)).cast("double").alias("df"))
        counted.repartitionByRange(max(1, partitions // 8), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/frequencies")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        spark.createDataFrame([(self.tokenizer,)], "tokenizer string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tokenizer")

    @classmethod
    def load(cls, spark, path: str) -> TextIndex:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("postings"), read("stats"), read("frequencies"), read("tokenizer").first()[0])

    def counts(self) -> DataFrame:
        """(field, n, mean, terms, postings) of each field."""
        by = self.frequencies.groupBy("field").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").cast("long").alias("postings"))
        return self.stats.join(by, "field", "left").select("field", "n", "mean", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("postings", F.lit(0)).alias("postings"))

    def _own_words(self, node: Node) -> Node:
        """The query in the index's own tokens: a word that is several becomes a phrase of them, or more words of its phrase."""
        split = SPLITTERS[self.tokenizer]
        if node.op == "term":
            found = split(node.words[0])
            return Node("phrase" if len(found) > 1 else "term", found, 0, node.only) if found else node
        if node.op == "phrase":
            return Node("phrase", [x for w in node.words for x in split(w)], node.slop, node.only)
        return Node(node.op, node.words, node.slop, node.only, [self._own_words(p) for p in node.parts])

    def keyword(self, chunks: DataFrame, query: str | Node, where: Column | None = None, k1: float = 1.2, b: float = 0.75, text_boost: float = 1.0, heading_boost: float = 2.0) -> DataFrame:
        """As keyword_search, from the postings of the query's words only; of the chunks no text is read.

        The frequencies of the query's words, a few rows, come to the driver.
        """
        node = self._own_words(parse_query(query) if isinstance(query, str) else query)
        live = chunks.where("searchable").where(F.lit(True) if where is None else where)
        found = leaves(node)
        if not found:
            return live.withColumn("bm25", F.lit(1.0)) if node.op == "all" else live.where(_holds(node, lambda _: F.lit(False))).withColumn("bm25", F.lit(0.0))
        words = sorted({w for x in found if x.op != "prefix" for w in x.words})
        starts = sorted({x.words[0] for x in found if x.op == "prefix"})
        term = F.col("term")
        wanted = any_of(([term.isin(words)] if words else []) + [term.startswith(p) for p in starts])
        phrased = {w for x in found if x.op == "phrase" for w in x.words}
        is_ = {(f, w): (F.col("field") == f) & (term == w) for f in FIELDS for w in words}
        name = {k: f"h{i}" for i, k in enumerate(is_)}
        aggregates = [F.max(F.when(c, F.col("tf"))).alias(f"{name[k]}_tf") for k, c in is_.items()]
        aggregates += [F.max(F.when(c, F.col("positions"))).alias(f"{name[k]}_at") for k, c in is_.items() if k[1] in phrased]
        aggregates += [F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"dl_{f}") for f in FIELDS]
        aggregates += [F.max((F.col("field") == f) & term.startswith(p)).alias(f"p{i}_{f}") for i, p in enumerate(starts) for f in FIELDS]
        hits = self.postings.where(wanted).groupBy(*GID).agg(*aggregates)

        def leaf(x: Node) -> Column:
            fields = [x.only] if x.only else FIELDS
            if x.op == "term":
                return any_of([F.col(f"{name[f, x.words[0]]}_tf").isNotNull() for f in fields])
            if x.op == "prefix":
                return any_of([F.coalesce(F.col(f"p{starts.index(x.words[0])}_{f}"), F.lit(False)) for f in fields])
            return any_of([_within([F.col(f"{name[f, w]}_at") for w in x.words], x.slop) for f in fields])

        rows = live.join(hits, list(GID), "left" if matches_nothing_known(node) else "inner").where(_holds(node, leaf))
        terms, prefixes = scored(node)
        stats = {r["field"]: r for r in self.stats.collect()}
        df = {(r["field"], r["term"]): r["df"] for r in self.frequencies.where(term.isin(sorted({w for _, w in terms}))).collect()} if terms else {}
        score, boosts = F.lit(0.0), {"text": text_boost, "heading": heading_boost}
        for f, w in sorted(terms):
            if (f, w) in df:
                part = _contribution(F.col(f"{name[f, w]}_tf").cast("double"), F.col(f"dl_{f}").cast("double"), idf(F.lit(stats[f]["n"]), F.lit(df[f, w])), F.lit(stats[f]["mean"]), F.lit(float(boosts[f])), k1, b)
                score = score + F.coalesce(part, F.lit(0.0))
        for x in prefixes:
            score = score + F.when(leaf(x), 1.0).otherwise(0.0)
        return rows.withColumn("bm25", score).select(*chunks.columns, "bm25")

    def search(self, queries: DataFrame, k1: float = 1.2, b: float = 0.75, text_boost: float = 1.0, heading_boost: float = 2.0) -> DataFrame:
        """(query_id, gid, bm25) of every chunk with a word of each query of (query_id, query)."""
        wanted, parts = self._parts(queries, k1, b, text_boost, heading_boost)
        return parts.join(wanted, "term").groupBy("query_id", *GID).agg(F.sum("part").alias("bm25"))

    def _parts(self, queries: DataFrame, k1: float, b: float, text_boost: float, heading_boost: float) -> tuple[DataFrame, DataFrame]:
        """(query_id, term) of the queries, and (gid, term, part): what each posting of their words adds to a score."""
        wanted = queries.select("query_id", F.explode(F.array_distinct(TOKENIZERS[self.tokenizer](F.col("query")))).alias("term"))
        # each term's weight once, a row for each word of the queries, sent to the postings, which don't move for it
        weights = self.frequencies.join(wanted.select("term").distinct(), "term", "left_semi").join(self.stats, "field")
        boost = F.when(F.col("field") == "text", F.lit(float(text_boost))).otherwise(F.lit(float(heading_boost)))
        part = _contribution(F.col("tf").cast("double"), F.col("dl").cast("double"), idf(F.col("n"), F.col("df")), F.col("mean"), boost, k1, b)
        return wanted, self.postings.drop("positions").join(F.broadcast(weights), ["term", "field"]).select(*GID, "term", part.alias("part"))

    def best(self, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, text_boost: float = 1.0, heading_boost: float = 2.0, block: int = 4096, asked: int = 512) -> DataFrame:
        """As ``search``, of every block of about ``block`` chunks the k best of each query, and what scores as they do to 9 digits.

        The k best of all are among them.  A block's scores are a matrix product,
        in one task with ``asked`` queries: no row is made for each chunk of each query.
        """
        wanted, parts = self._parts(queries, k1, b, text_boost, heading_boost)
        n = max(1, -(-int(self.stats.agg(F.max("n")).first()[0] or 0) // block))
        m = max(1, -(-queries.count() // asked))
        grid = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
        left = parts.withColumn("i", F.pmod(F.xxhash64(*GID), F.lit(n)).cast("int")).withColumn("j", grid(m) if m > 1 else F.lit(0))
        right = wanted.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).withColumn("i", grid(n))
        kind = queries.schema["query_id"].dataType.simpleString()
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_best_of_block(k), f"query_id {kind}, collection string, doc_id string, chunk_id long, bm25 double")
