"""Searches over a chunk table: one request, one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import highlight, similar_query
from ..model import GID, citation_id, complete, encode_cursor, split_citation
from ..operators import ranking
from ..operators.text import TextIndex, keyword_search, parse_query, scored
from ..operators.vectors import ClusterIndex, knn
from ..sources.store import ChunkStore
from .filters import compile_filter, targets_image, visible
from .request import Caller, SearchRequest


def public_media(media: Column) -> Column:
    """A media reference without the places of stored objects."""
    hide = lambda asset: F.when(asset["kind"] == "object", F.struct(asset["kind"].alias("kind"), F.lit(None).cast("string").alias("uri"), asset["page"].alias("page"), asset["bbox"].alias("bbox"))).otherwise(asset)
    return media.withField("asset", hide(media["asset"])).withField("thumbnail", hide(media["thumbnail"]))


class SearchEngine:
    """Keyword, vector and hybrid search with access control.

    embed: query text -> vector, for vector searches by text.  cross_modal: its
    vectors of texts and images can be compared.  text: an index of the chunks'
    words; vectors: one of their vectors.  Without them a search reads the chunk
    table.  reranker: (query, column of texts) -> column of scores.
    """

    #: Columns of chunks that only hits need.
    WIDE = ("text", "metadata", "media", "bbox", "embedding")

    def __init__(self, chunks: DataFrame, embed=None, cross_modal: bool = False, text: TextIndex | None = None, vectors: ClusterIndex | None = None, reranker=None):
        self.chunks, self.embed, self.cross_modal, self.text, self.vectors, self.reranker = complete(chunks), embed, cross_modal, text, vectors, reranker

    @classmethod
    def create(cls, chunks: DataFrame, path: str, tokenizer: str = "default", clusters: int | None = None, **options) -> SearchEngine:
        """Writes chunks (sorted by identifier), postings and clusters of vectors under ``path``, and opens them.

        Everything but the chunks can be made again from them: see ``rebuild``.
        """
        ChunkStore(chunks.sparkSession, f"{path}/chunks").write(complete(chunks))
        return cls.rebuild(chunks.sparkSession, path, tokenizer, clusters, **options)

    @classmethod
    def rebuild(cls, spark: SparkSession, path: str, tokenizer: str = "default", clusters: int | None = None, **options) -> SearchEngine:
        """All indexes anew, from the stored chunks."""
        chunks = ChunkStore(spark, f"{path}/chunks").read()
        TextIndex.build(chunks, tokenizer).save(f"{path}/text")
        if "embedding" in chunks.columns:
            few = [c for c in chunks.columns if c not in cls.WIDE or c == "embedding"]
            ClusterIndex.build(chunks.select(few), clusters).save(f"{path}/vectors")
        return cls.open(spark, path, **options)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> SearchEngine:
        chunks = ChunkStore(spark, f"{path}/chunks").read()
        vectors = ClusterIndex.load(spark, f"{path}/vectors") if "embedding" in chunks.columns else None
        return cls(chunks, text=TextIndex.load(spark, f"{path}/text"), vectors=vectors, **options)

    def lookup(self, hits: DataFrame) -> DataFrame:
        """The chunks of hits, with the hits' columns.  Hits are some thousands at most: their identifiers choose what is read."""
        rows = hits.collect()
        docs = sorted({r["doc_id"] for r in rows})
        few = self.chunks.sparkSession.createDataFrame(rows, hits.schema)
        chunks = self.chunks.where(F.col("doc_id").between(docs[0], docs[-1]) & F.col("collection").isin(sorted({r["collection"] for r in rows}))) if docs else self.chunks.limit(0)
        if 0 < len(docs) <= 1000:
            chunks = chunks.where(F.col("doc_id").isin(docs))
        return chunks.join(F.broadcast(few), list(GID))

    def search(self, request: SearchRequest, caller: Caller = Caller(), query_image: bytes | None = None) -> DataFrame:
        """Hits in order: gid, citation_id, score, bm25, vector, rerank, sort_key, page, section_id, heading_path and what the request asks for.

        score is the fused score, for one list too; bm25 and vector are the
        lists' own scores.  After fusion come, in this order: merging of
        sections, reranking of the best, groups, cursor, limit.
        """
        r = request.validate()
        if query_image is not None and not self.cross_modal:
            raise ValueError("image queries need a cross-modal embedder")
        vector = r.vector
        if vector is None and r.mode != "keyword" and self.embed is not None and (r.query.strip() or query_image) and (self.cross_modal or not targets_image(r.filter)):
            vector = self.embed(query_image if query_image is not None else r.query)
        by_vector = r.mode != "keyword" and vector is not None
        by_keyword = r.mode == "keyword" or (r.mode == "hybrid" and not (by_vector and not r.query.strip()))
        where = visible(caller.tenant, caller.tags) & compile_filter(r.filter)
        keyword = self.keyword_candidates(r, where) if by_keyword else None
        nearest = self.vector_candidates(r, vector, where) if by_vector else None
        if keyword is None and nearest is None:
            return self._finish(self.chunks.limit(0).withColumns({"score": F.lit(0.0), "bm25": F.lit(0.0), "vector": F.lit(0.0)}), r)
        hits = ranking.fuse(keyword, nearest, r.fusion, r.rank_constant, r.ratio)
        # texts and the rest are read for the few hits only
        return self._finish(self.lookup(hits), r)

    def keyword_candidates(self, r: SearchRequest, where: Column) -> DataFrame:
        options = (where, r.k1, r.b, r.text_boost, r.heading_boost)
        if self.text is not None:
            slim = self.chunks.drop(*self.WIDE)
            return ranking.top(self.text.keyword(slim, r.query, *options), "bm25", r.candidates)
        return ranking.top(keyword_search(self.chunks, parse_query(r.query), *options), "bm25", r.candidates)

    def vector_candidates(self, r: SearchRequest, vector: list[float], where: Column) -> DataFrame:
        if self.vectors is not None:
            return self.vectors.search(vector, r.candidates, r.probes, where)
        return knn(self.chunks, vector, r.candidates, where)

    def _finish(self, hits: DataFrame, r: SearchRequest) -> DataFrame:
        hits = hits.withColumns({"rerank": F.lit(None).cast("double"), "sort_key": F.col("score"), "merged_chunk_ids": F.array().cast("array<bigint>")})
        if r.auto_merge:
            hits = ranking.auto_merge(hits)
        if r.rerank:
            hits = ranking.rerank(hits.drop("rerank"), r.query, r.rerank, self.reranker).withColumn("sort_key", F.col("rerank"))
        if r.collapse:
            hits = ranking.collapse(hits, r.collapse, r.max_per_group, "sort_key")
        if r.search_after:
            hits = ranking.after(hits, r.search_after)
        extra = []
        if r.highlight:
            extra.append(highlight(F.col("text"), sorted({w for _, w in scored(parse_query(r.query))[0]})).alias("highlight"))
        extra += [F.col("text")] if r.include_text else []
        extra += [F.col("metadata")] if r.include_metadata else []
        if "media" in hits.columns:
            extra.append(public_media(F.col("media")).alias("media"))
        return ranking.top(hits, "sort_key", r.top_k).select(*GID, citation_id().alias("citation_id"), "score", "bm25", "vector", "rerank", "sort_key", "kind", "page", "section_id", "heading_path", "merged_chunk_ids", *extra)

    def facets(self, request: SearchRequest, caller: Caller = Caller()) -> DataFrame:
        """Counts over the keyword candidates; none in vector mode."""
        r = request.validate()
        where = visible(caller.tenant, caller.tags) & compile_filter(r.filter)
        hits = self.keyword_candidates(r, where) if r.mode != "vector" else self.chunks.limit(0)
        return ranking.facets(hits, r.facets)

    def pages(self, request: SearchRequest, caller: Caller = Caller()):
        """Successive pages of rows, until one is short."""
        r = request
        while True:
            rows = self.search(r, caller).collect()
            if rows:
                yield rows
            if len(rows) < r.top_k:
                return
            r = replace(r, search_after=encode_cursor(rows[-1]["sort_key"], rows[-1]["citation_id"]))

    def similar(self, citation: str, k: int = 10, caller: Caller = Caller(), **options) -> DataFrame:
        """Hits for a chunk's own words, without it.  A chunk that the caller can't see has none."""
        gid = split_citation(citation)
        here = (F.col("collection") == gid[0]) & (F.col("doc_id") == gid[1]) & (F.col("chunk_id") == gid[2]) if gid else F.lit(False)
        seed = self.chunks.where(here & F.col("searchable") & visible(caller.tenant, caller.tags)).select("text").first()
        query = similar_query(seed["text"]) if seed else ""
        if not query:
            return self.search(SearchRequest(mode="keyword", filter={"in": ["doc_id", []]}), caller)
        # words only: nothing of the text is read as syntax
        hits = self.search(SearchRequest(query=query.lower(), mode="keyword", top_k=k + 1, candidates=max(150, k + 1), **options), caller)
        return ranking.top(hits.where(~here), "sort_key", k)

    def resolve(self, citations: list[str], caller: Caller = Caller()) -> DataFrame:
        """citation_id, kind (doc_render, signed_url or inline_ref), page, bbox and media of those that exist and the caller sees."""
        gids = [g for g in map(split_citation, citations) if g]
        ids = self.chunks.sparkSession.createDataFrame(gids, "collection string, doc_id string, chunk_id long")
        rows = self.chunks.where(visible(caller.tenant, caller.tags)).join(F.broadcast(ids.distinct()) if len(gids) <= 10_000 else ids.distinct(), list(GID))
        asset = F.col("media")["asset"]["kind"] if "media" in rows.columns else F.lit(None).cast("string")
        how = F.when(asset == "object", "signed_url").when(asset == "inline", "inline_ref").otherwise("doc_render")
        return rows.select(citation_id().alias("citation_id"), how.alias("resolve_as"), "page", *(["bbox"] if "bbox" in rows.columns else []), *([public_media(F.col("media")).alias("media")] if "media" in rows.columns else []))

    def context(self, hits: DataFrame) -> str:
        """Hits with text as numbered lines for a language model."""
        rows = hits.orderBy(*ranking.order("sort_key")).select(F.format_string("(%s p.%d) %s", "doc_id", "page", "text").alias("line")).collect()
        return "\n".join(f"[{i}] {r['line']}" for i, r in enumerate(rows, 1))
