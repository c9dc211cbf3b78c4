"""Ranks, fusion, groups, facets, reranking and cursors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigram_tokens, jaccard
from ..model import GID, decode_cursor

DOUBLE_EPSILON = 2.220446049250313e-16


def order(score: str | Column) -> list[Column]:
    """Best first; ties by identifier."""
    return [F.desc(score) if isinstance(score, str) else score.desc(), *[F.asc(c) for c in GID]]


def top(hits: DataFrame, score: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best, of each group if ``by`` is given."""
    if not by:
        return hits.orderBy(*order(score)).limit(k)
    w = Window.partitionBy(*by).orderBy(*order(score))
    return hits.withColumn("top_rank", F.row_number().over(w)).where(F.col("top_rank") <= k).drop("top_rank")


def fuse(keyword: DataFrame | None, vector: DataFrame | None, method: str = "rrf", rank_constant: float = 60.0, ratio: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(gid, score, bm25, vector) of hits in either list; keyword has bm25, vector has vector.

    rrf adds 1 / (rank_constant + rank).  normalized and weighted scale each
    list to [0, 1] (a list of equal scores to 1) and mix them by ratio.
    """
    lists = []
    for hits, name, weight in ((keyword, "bm25", 1.0 - ratio), (vector, "vector", ratio)):
        if hits is None:
            continue
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        if method == "rrf":
            part = 1.0 / (F.lit(float(rank_constant)) + F.row_number().over(group.orderBy(*order(name))))
        else:
            low, high = F.min(name).over(group), F.max(name).over(group)
            part = F.lit(weight) * F.when(high - low <= DOUBLE_EPSILON, 1.0).otherwise((F.col(name) - low) / (high - low))
        other = "vector" if name == "bm25" else "bm25"
        lists.append(hits.select(*by, *GID, part.alias("part"), F.col(name).cast("double").alias(name), F.lit(None).cast("double").alias(other)))
    union = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
    return union.groupBy(*by, *GID).agg(F.sum("part").alias("score"), F.max("bm25").alias("bm25"), F.max("vector").alias("vector"))


def facets(hits: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(facet, value, n) over keyword candidates for kind, modality and doc_id; other fields are ignored."""
    known = [f for f in fields if f in ("kind", "modality", "doc_id")]
    if not known:
        return hits.select(F.lit("").alias("facet"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n")).limit(0)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in known]))
    return hits.select(pairs.alias("p")).select("p.*").where("value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("facet", F.desc("n"), "value")


def auto_merge(hits: DataFrame, score: str = "score") -> DataFrame:
    """One hit for each section: the best; merged_chunk_ids has the others.  Section 0 is none and stays apart."""
    by = Window.partitionBy("collection", "doc_id", "section_id")
    alone = F.col("section_id") == 0
    return (
        hits.withColumns({"m_rank": F.row_number().over(by.orderBy(*order(score))), "m_ids": F.array_sort(F.collect_set("chunk_id").over(by))})
        .where(alone | (F.col("m_rank") == 1))
        .withColumn("merged_chunk_ids", F.when(alone, F.array().cast("array<bigint>")).otherwise(F.array_remove("m_ids", F.col("chunk_id"))))
        .drop("m_rank", "m_ids")
    )


def collapse(hits: DataFrame, field: str, most: int = 1, score: str = "score") -> DataFrame:
    """At most ``most`` hits of a document (doc_id) or section (section_id); other fields change nothing."""
    keys = {"doc_id": ["collection", "doc_id"], "section_id": ["collection", "doc_id", "section_id"]}.get(field)
    return top(hits, score, most, keys) if keys else hits


def rerank(hits: DataFrame, query: str, k: int, by: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """The k best by score, with rerank: what ``by`` makes of the query and the texts, or the Jaccard similarity of their words."""
    score = by(query, F.col("text")) if by else jaccard(bigram_tokens(F.col("text")), bigram_tokens(F.lit(query)))
    return top(hits, "score", k).withColumn("rerank", score.cast("double"))


def after(hits: DataFrame, cursor: str, key: str = "sort_key") -> DataFrame:
    """What comes after the row of a cursor."""
    value, gid = decode_cursor(cursor)
    here = F.struct(*[F.col(c) for c in GID])
    there = F.struct(F.lit(gid[0]).alias("collection"), F.lit(gid[1]).alias("doc_id"), F.lit(gid[2]).cast("bigint").alias("chunk_id"))
    return hits.where((F.col(key) < value) | ((F.col(key) == value) & (here > there)))
