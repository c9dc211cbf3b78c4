"""Every operator as a query over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import media as M
from .functions import vector as V
from .functions.text import bigram_tokens, highlight, tokens
from .model import GID, citation_id, complete, encode_cursor, parse_citation
from .operators import embedding, evaluation, ranking
from .operators.text import TextIndex, keyword_search
from .operators.vectors import ClusterIndex, CompressedIndex, binary_codes, knn, knn_batch, two_stage
from .plans.engine import SearchEngine
from .plans.filters import ROW_FIELDS, compile_filter, visible
from .plans.request import Caller, SearchRequest
from .sources import changes, ingest, objects
from .streaming import cdc, service

KINDS_8 = ["heading", "paragraph", "table", "code", "list_item", "image", "audio", "video"]
CALLER = Caller("acme", ("team-a",))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_view(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """documents as chunks: five to a document, with kinds, sections, tenants and access lists."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    if vectors:
        e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        d = d.join(e, "doc_id", "left")
    media = i % 8 >= 6
    return complete(
        d.select(
            F.when(i % 4 < 3, "kb").otherwise("aux").alias("collection"),
            F.concat(F.lit("doc"), F.floor(i / 5)).alias("doc_id"),
            i.alias("chunk_id"),
            F.element_at(F.array(*[F.lit(k) for k in KINDS_8]), (i % 8 + 1).cast("int")).alias("kind"),
            "text",
            (i % 50 + 1).cast("int").alias("page"),
            (F.floor(i / 2) % 3).alias("section_id"),
            F.array("source", "lang").alias("heading_path"),
            F.when(i % 3 == 0, "acme").when(i % 3 == 1, "globex").alias("tenant"),
            F.when(i % 5 < 3, F.array(F.lit("public"))).when(i % 2 == 0, F.array(F.lit("team-a"))).otherwise(F.array(F.lit("team-b"))).alias("acl"),
            F.when(media, i * 1000).alias("time_start_ms"),
            F.when(media, i * 1000 + 500).alias("time_end_ms"),
            (i % 17 != 0).alias("searchable"),
            F.col("n_chars").cast("int").alias("char_len"),
            *(["embedding"] if vectors else []),
        )
    )


CHUNKS = f"""
chunks AS (SELECT CASE WHEN d.doc_id % 4 < 3 THEN 'kb' ELSE 'aux' END AS collection, 'doc' || (d.doc_id // 5) AS doc_id, d.doc_id AS chunk_id,
  {KINDS_8}[d.doc_id % 8 + 1] AS kind, CASE WHEN d.doc_id % 8 >= 5 THEN {KINDS_8}[d.doc_id % 8 + 1] ELSE 'text' END AS modality, coalesce(text, '') AS text,
  (d.doc_id % 50 + 1)::INT AS page, (d.doc_id // 2) % 3 AS section_id, [source, lang] AS heading_path,
  CASE d.doc_id % 3 WHEN 0 THEN 'acme' WHEN 1 THEN 'globex' END AS tenant,
  CASE WHEN d.doc_id % 5 < 3 THEN ['public'] WHEN d.doc_id % 2 = 0 THEN ['team-a'] ELSE ['team-b'] END AS acl,
  CASE WHEN d.doc_id % 8 >= 6 THEN d.doc_id * 1000 END AS time_start_ms, CASE WHEN d.doc_id % 8 >= 6 THEN d.doc_id * 1000 + 500 END AS time_end_ms,
  d.doc_id % 17 <> 0 AS searchable, n_chars::INT AS char_len, e.embedding::DOUBLE[] AS v,
  (CASE WHEN d.doc_id % 4 < 3 THEN 'kb' ELSE 'aux' END) || ':doc' || (d.doc_id // 5) || ':' || d.doc_id AS citation_id
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
SEE = "(tenant = 'acme' AND (list_contains(acl, 'public') OR list_contains(acl, 'team-a')))"


def _tok(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


INDEX = f"""
idx AS (SELECT *, {_tok("text")} AS tt, {_tok("array_to_string(heading_path, ' ')")} AS ht FROM chunks WHERE searchable),
st AS (SELECT count(*)::DOUBLE AS n, greatest(sum(len(tt))::DOUBLE / count(*), 1e0) AS mt, greatest(sum(len(ht))::DOUBLE / count(*), 1e0) AS mh FROM idx)"""


def bm25_sql(words: list[str], where: str = "true", match: str | None = None, k1: float = 1.2, b: float = 0.75, tb: float = 1.0, hb: float = 2.0, extra: str = "") -> str:
    """CTEs up to ``kw``: the matching chunks with bm25."""
    parts = []
    for w in words:
        for f, boost, mean in (("tt", tb, "mt"), ("ht", hb, "mh")):
            df = f"(SELECT count(*) FILTER (list_contains({f}, '{w}'))::DOUBLE FROM idx)"
            tf = f"len(list_filter({f}, lambda t: t = '{w}'))::DOUBLE"
            parts.append(f"({boost:e} * ln(1e0 + (n - {df} + 5e-1) / ({df} + 5e-1)) * {tf} * {k1 + 1:e} / ({tf} + {k1:e} * ({1 - b:e} + {b:e} * len({f}) / {mean})))")
    hit = match or " OR ".join(f"list_contains({f}, '{w}')" for w in words for f in ("tt", "ht"))
    return f"WITH {CHUNKS}, {INDEX}, kw AS (SELECT idx.*, {' + '.join(parts) or '0e0'}{extra} AS bm25 FROM idx, st WHERE ({hit}) AND ({where}))"


ORDER = "collection, doc_id, chunk_id"
COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"
QVEC = "qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 7").first()["embedding"]]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _ids(df: DataFrame, **scores: Column) -> DataFrame:
    return df.select(citation_id().alias("citation_id"), *[F.round(c, 6).alias(n) for n, c in scores.items()])


# engines: the index of a folder's tables is written once a session

_ENGINES: dict[tuple, str] = {}


def _fingerprint(spark: SparkSession, df: DataFrame) -> tuple:
    """Files of a table with size and time: another table at the same path is another index."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in sorted(df.inputFiles()):
        p = path(name)
        status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def engine(spark: SparkSession, sf_dir: str) -> SearchEngine:
    """Over the stored chunks and indexes of a folder's documents and embeddings, which the first call of a session writes.

    They go to the shared folder of spark.checkpoint.dir; in local mode, where
    none is set, to a temporary one.
    """
    key = (spark.sparkContext.applicationId, *(_fingerprint(spark, table(spark, sf_dir, t)) for t in ("documents", "embeddings")))
    if key not in _ENGINES:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="engine-")
        path = f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}"
        SearchEngine.create(chunk_view(spark, sf_dir, True), path)
        _ENGINES[key] = path
    return SearchEngine.open(spark, _ENGINES[key])


# full text

_TWO = ["the", "thing"]


def _keyword_sql(words, where=SEE, limit=20, **kw) -> str:
    return bm25_sql(words, where, **kw) + f" SELECT citation_id, round(bm25, 6) AS bm25 FROM kw ORDER BY bm25 DESC, {ORDER} LIMIT {limit}"


def _keyword(spark, sf_dir, text, where=None, limit=20, **kw) -> DataFrame:
    e = engine(spark, sf_dir)
    hits = e.text.keyword(e.chunks.drop(*e.WIDE), text, visible("acme", ("team-a",)) if where is None else where, **kw)
    return _ids(ranking.top(hits, "bm25", limit), bm25=F.col("bm25"))


@query(_keyword_sql(_TWO, SEE + " AND collection = 'kb' AND page <= 40", 10))
def bm25_topk(spark, sf_dir):
    where = visible("acme", ("team-a",)) & compile_filter({"and": [{"eq": ["collection", "kb"]}, {"lte": ["page", 40]}]})
    return _keyword(spark, sf_dir, "the thing", where, 10)


@query(_keyword_sql(_TWO, SEE + " AND collection = 'kb' AND page <= 40", 10))
def bm25_scan(spark, sf_dir):
    """The same without an index."""
    where = visible("acme", ("team-a",)) & compile_filter({"and": [{"eq": ["collection", "kb"]}, {"lte": ["page", 40]}]})
    return _ids(ranking.top(keyword_search(chunk_view(spark, sf_dir), "the thing", where), "bm25", 10), bm25=F.col("bm25"))


@query(_keyword_sql(["src3", "en"], "true", hb=5.0))
def bm25_heading_boost(spark, sf_dir):
    return _keyword(spark, sf_dir, "src3 en", F.lit(True), heading_boost=5.0)


@query(_keyword_sql(_TWO, "true", k1=2.0, b=0.3))
def bm25_custom_k1b(spark, sf_dir):
    return _keyword(spark, sf_dir, "the thing", F.lit(True), k1=2.0, b=0.3)


@query(
    "WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(" + _tok("text") + ", lambda t: t <> '')) AS ws FROM benchmark), qt AS (SELECT query_id, unnest(ws) AS term FROM q), "
    + CHUNKS + ", " + INDEX
    + """, f AS (SELECT collection, doc_id, chunk_id, citation_id, 'text' AS field, tt AS ts FROM idx UNION ALL SELECT collection, doc_id, chunk_id, citation_id, 'heading', ht FROM idx),
x AS (SELECT *, len(ts) AS dl FROM f), p AS (SELECT collection, doc_id, chunk_id, citation_id, field, dl, unnest(ts) AS term FROM x),
t AS (SELECT collection, doc_id, chunk_id, citation_id, field, term, dl, count(*)::DOUBLE AS tf FROM p GROUP BY ALL), df AS (SELECT term, field, count(*)::DOUBLE AS df FROM t GROUP BY ALL),
s AS (SELECT query_id, collection, doc_id, chunk_id, citation_id, sum(CASE field WHEN 'text' THEN 1e0 ELSE 2e0 END * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + 7.5e-1 * dl / CASE field WHEN 'text' THEN mt ELSE mh END))) AS bm25
      FROM t JOIN df USING (term, field) JOIN qt USING (term), st GROUP BY ALL)
SELECT query_id, citation_id, round(bm25, 6) AS bm25 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, collection, doc_id, chunk_id) <= 5"""
)
def bm25_batch(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = engine(spark, sf_dir).text.best(queries, 5).withColumn("key", F.round("bm25", 9))
    return ranking.top(hits, "key", 5, ["query_id"]).select("query_id", citation_id().alias("citation_id"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {CHUNKS}, {INDEX}, f AS (SELECT 'text' AS field, tt AS ts FROM idx UNION ALL SELECT 'heading', ht FROM idx), g AS (SELECT field, unnest(list_distinct(ts)) AS term FROM f), c AS (SELECT field, count(DISTINCT term) AS terms, count(*) AS postings FROM g GROUP BY field) SELECT field, n, round(CASE field WHEN 'text' THEN mt ELSE mh END, 6) AS mean, terms, postings FROM c, st")
def index_counts(spark, sf_dir):
    """An index built anew, in whole."""
    return TextIndex.build(chunk_view(spark, sf_dir)).counts().withColumn("mean", F.round("mean", 6))


_PREFIX = "len(list_filter({f}, lambda t: starts_with(t, 'wor'))) > 0"
_PRE = "(" + _PREFIX.format(f="tt") + " OR " + _PREFIX.format(f="ht") + ")"


@query(_keyword_sql(["idiot"], "true", match=f"{_PRE} OR list_contains(tt, 'idiot') OR list_contains(ht, 'idiot')", extra=f" + CASE WHEN {_PRE} THEN 1e0 ELSE 0e0 END"))
def prefix_search(spark, sf_dir):
    return _keyword(spark, sf_dir, "idiot wor*", F.lit(True))


@query(_keyword_sql(["of", "the"], "true", match="contains(' ' || array_to_string(tt, ' ') || ' ', ' of the ') OR contains(' ' || array_to_string(ht, ' ') || ' ', ' of the ')"))
def phrase_search(spark, sf_dir):
    return _keyword(spark, sf_dir, '"of the"', F.lit(True))


_SLOP = "len(list_filter(range(1, len({f}) + 1), lambda i: {f}[i] = 'of' AND list_contains({f}[i + 1:i + 3], 'thing'))) > 0"


@query(_keyword_sql(["of", "thing"], "true", match=_SLOP.format(f="tt") + " OR " + _SLOP.format(f="ht")))
def phrase_slop(spark, sf_dir):
    return _keyword(spark, sf_dir, '"of thing"~2', F.lit(True))


@query(_keyword_sql(["the"], "true", match="(list_contains(tt, 'the') OR list_contains(ht, 'the')) AND NOT (list_contains(tt, 'idiot') OR list_contains(ht, 'idiot'))"))
def boolean_query(spark, sf_dir):
    return _keyword(spark, sf_dir, "+the -idiot", F.lit(True))


@query(f"WITH {CHUNKS} SELECT citation_id, 1e0 AS bm25 FROM chunks WHERE searchable AND {SEE} AND kind = 'table' ORDER BY {ORDER} LIMIT 50")
def match_all_filtered(spark, sf_dir):
    return _keyword(spark, sf_dir, "  ", visible("acme", ("team-a",)) & compile_filter({"eq": ["kind", "table"]}), 50)


@query()
def highlight_hits(spark, sf_dir):
    hits = engine(spark, sf_dir).search(SearchRequest(query="idiot clown", mode="keyword", highlight=True, include_text=True), Caller("acme", ("team-a",)))
    return hits.select("citation_id", highlight(F.col("text"), ["idiot", "clown"]).alias("snippet"))


@query(f"WITH {CHUNKS}, i AS (SELECT {_tok('text')} AS tt FROM chunks WHERE searchable), t AS (SELECT unnest(tt) AS term FROM i) SELECT term, count(*) AS tf FROM t GROUP BY term")
def token_counts(spark, sf_dir):
    return chunk_view(spark, sf_dir).where("searchable").select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


# filters and access

_FILTERS = {
    "filter_eq": ({"eq": ["kind", "table"]}, "kind = 'table'"),
    "filter_ne": ({"ne": ["tenant", "acme"]}, "tenant <> 'acme'"),
    "filter_range": ({"and": [{"gte": ["page", 10]}, {"lt": ["page", 20.5]}]}, "page >= 10 AND page < 20.5"),
    "filter_in": ({"in": ["section_id", [1, 2, "x"]]}, "section_id IN (1, 2)"),
    "filter_exists": ({"exists": "time_start_ms"}, "time_start_ms IS NOT NULL"),
    "filter_heading_prefix": ({"heading_prefix": ["src3"]}, "heading_path[1] = 'src3'"),
    "filter_not": ({"not": {"or": [{"eq": ["tenant", "acme"]}, {"gt": ["time_start_ms", 500000]}]}}, "NOT coalesce(tenant = 'acme', false) AND NOT coalesce(time_start_ms > 500000, false)"),
    "filter_nested": ({"or": [{"and": [{"eq": ["modality", "image"]}, {"not": {"in": ["page", [1, 2, 3]]}}]}, {"eq": ["doc_id", "doc7"]}]}, "(modality = 'image' AND page NOT IN (1, 2, 3)) OR doc_id = 'doc7'"),
    "filter_type_mismatch": ({"or": [{"gt": ["kind", 3]}, {"ne": ["page", "x"]}]}, "page IS NOT NULL"),
    "filter_unknown_field": ({"not": {"eq": ["colour", "red"]}}, "true"),
}


def _filter_query(name: str, tree: dict, sql: str) -> None:
    def run(spark, sf_dir):
        return chunk_view(spark, sf_dir).where(compile_filter(tree)).select(*GID)

    run.__name__ = name
    query(f"WITH {CHUNKS} SELECT collection, doc_id, chunk_id FROM chunks WHERE {sql}")(run)


for _name, (_tree, _sql) in _FILTERS.items():
    _filter_query(_name, _tree, _sql)


@query(f"WITH {CHUNKS} SELECT collection, doc_id, chunk_id FROM chunks WHERE char_len > 2000 AND searchable")
def filter_row_fields(spark, sf_dir):
    return chunk_view(spark, sf_dir).where(compile_filter({"and": [{"gt": ["char_len", 2000]}, {"eq": ["searchable", True]}]}, ROW_FIELDS)).select(*GID)


@query(f"WITH {CHUNKS} SELECT collection, doc_id, chunk_id FROM chunks WHERE {SEE}")
def acl_visible(spark, sf_dir):
    return chunk_view(spark, sf_dir).where(visible("acme", ("team-a",))).select(*GID)


@query(f"WITH {CHUNKS} SELECT collection, doc_id, chunk_id FROM chunks WHERE list_contains(acl, 'public')")
def acl_without_tenant(spark, sf_dir):
    return chunk_view(spark, sf_dir).where(visible(None)).select(*GID)


# vectors


def _knn_sql(where: str, k: int = 20) -> str:
    return f"WITH {CHUNKS}, {QVEC} SELECT citation_id, round({COS}, 6) AS vector FROM chunks, qv WHERE searchable AND v IS NOT NULL AND {where} ORDER BY {COS} DESC, {ORDER} LIMIT {k}"


@query(_knn_sql("true"))
def knn_exact(spark, sf_dir):
    return _ids(knn(chunk_view(spark, sf_dir, True), query_vector(spark, sf_dir), 20), vector=F.col("vector"))


@query(_knn_sql(SEE + " AND kind <> 'table'"))
def knn_filtered(spark, sf_dir):
    return _ids(knn(chunk_view(spark, sf_dir, True), query_vector(spark, sf_dir), 20, visible("acme", ("team-a",)) & compile_filter({"ne": ["kind", "table"]})), vector=F.col("vector"))


@query(
    f"WITH {CHUNKS}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings), s AS (SELECT query_id, citation_id, {ORDER}, {COS} AS vector FROM chunks, q WHERE searchable AND v IS NOT NULL) "
    f"SELECT query_id, citation_id, round(vector, 5) AS vector FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vector, 9) DESC, {ORDER}) <= 5"
)
def knn_batch_all(spark, sf_dir):
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn_batch(chunk_view(spark, sf_dir, True), queries, 5).select("query_id", citation_id().alias("citation_id"), F.round("vector", 5).alias("vector"))


@query(f"WITH {CHUNKS} SELECT citation_id, array_to_string(list_transform(v, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS code, round(list_sum(list_transform(v, lambda x: abs(x))) / sqrt(list_dot_product(v, v)), 6) AS l1 FROM chunks WHERE v IS NOT NULL")
def binary_code_table(spark, sf_dir):
    return binary_codes(chunk_view(spark, sf_dir, True)).select(citation_id().alias("citation_id"), "code", F.round("l1", 6).alias("l1"))


@query()
def rabitq_two_stage(spark, sf_dir):
    return _ids(two_stage(chunk_view(spark, sf_dir, True), query_vector(spark, sf_dir), 10, 8), vector=F.col("vector"))


@query()
def quantised_search(spark, sf_dir):
    chunks = chunk_view(spark, sf_dir, True)
    return _ids(CompressedIndex.build(chunks, 64, 4).search(query_vector(spark, sf_dir), 10, chunks=chunks), vector=F.col("vector"))


@query()
def quantised_codes_only(spark, sf_dir):
    return _ids(CompressedIndex.build(chunk_view(spark, sf_dir, True), 64, 4).search(query_vector(spark, sf_dir), 10), vector=F.col("vector"))


@query()
def cluster_search(spark, sf_dir):
    """Approximate: a quarter of the clusters, 10 at least; tests measure its recall."""
    return _ids(engine(spark, sf_dir).vectors.search(query_vector(spark, sf_dir), 10), vector=F.col("vector"))


@query(_knn_sql(SEE + " AND kind <> 'table'", 10))
def cluster_search_all(spark, sf_dir):
    """With as many probes as clusters the index is exact."""
    index = engine(spark, sf_dir).vectors
    return _ids(index.search(query_vector(spark, sf_dir), 10, len(index.centroids), visible("acme", ("team-a",)) & compile_filter({"ne": ["kind", "table"]})), vector=F.col("vector"))


_EMB = f"""WITH {CHUNKS}, t AS (SELECT citation_id, unnest({_tok('text')}) AS w FROM chunks WHERE searchable),
m AS (SELECT citation_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 16 AS place, CASE WHEN ('0x' || substr(md5(w), 9, 8))::BIGINT % 2 = 0 THEN 1e0 ELSE -1e0 END AS sgn FROM t),
s AS (SELECT citation_id, place, sum(sgn) AS x FROM m GROUP BY ALL), n AS (SELECT citation_id, sqrt(sum(x * x)) AS n FROM s GROUP BY citation_id)
SELECT c.citation_id, r.place::INT AS place, round(coalesce(CASE WHEN n > 0 THEN x / n ELSE 0 END, 0e0), 4) AS x
FROM (SELECT citation_id FROM chunks WHERE searchable) c CROSS JOIN (SELECT unnest(range(0, 16)) AS place) r LEFT JOIN s ON s.citation_id = c.citation_id AND s.place = r.place LEFT JOIN n ON n.citation_id = c.citation_id"""


@query(_EMB)
def hash_embedder(spark, sf_dir):
    rows = chunk_view(spark, sf_dir).where("searchable").select(citation_id().alias("citation_id"), V.hash_embedding(tokens(F.col("text")), 16).alias("e"))
    return rows.select("citation_id", F.posexplode("e").alias("place", "x")).withColumn("x", F.round(F.col("x").cast("double"), 4))


# fusion and the pipeline

_KW = f"k AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, {ORDER}) AS r FROM kw QUALIFY r <= 50)"
_VEC = f"{QVEC}, vs AS (SELECT *, {COS} AS vector FROM chunks, qv WHERE searchable AND v IS NOT NULL AND {SEE}), n AS (SELECT *, row_number() OVER (ORDER BY vector DESC, {ORDER}) AS r FROM vs QUALIFY r <= 50)"
_GID = "collection, doc_id, chunk_id, citation_id, section_id, text"


def _fusion_sql(kind: str, tail: str = "", cols: str = "citation_id, round(score, 6) AS score, round(bm25, 6) AS bm25, round(vector, 6) AS vector", limit: int = 20) -> str:
    if kind == "rrf":
        parts = "1e0 / (6e1 + r)", "1e0 / (6e1 + r)"
    else:
        norm = "CASE WHEN max({x}) OVER () - min({x}) OVER () <= 2.220446049250313e-16 THEN 1e0 ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"
        parts = "7e-1 * " + norm.format(x="bm25"), "3e-1 * " + norm.format(x="vector")
    return (
        bm25_sql(_TWO, SEE)
        + f", {_KW}, {_VEC}, u AS (SELECT {_GID}, {parts[0]} AS part, bm25, NULL::DOUBLE AS vector FROM k UNION ALL SELECT {_GID}, {parts[1]}, NULL, vector FROM n), "
        + f"h AS (SELECT {_GID}, sum(part) AS score, max(bm25) AS bm25, max(vector) AS vector FROM u GROUP BY ALL)"
        + (tail or f" SELECT {cols} FROM h ORDER BY score DESC, {ORDER} LIMIT {limit}")
    )


def _hybrid(spark, sf_dir, **kw) -> DataFrame:
    e = engine(spark, sf_dir)
    r = SearchRequest(**({"query": "the thing", "vector": query_vector(spark, sf_dir), "candidates": 50, "top_k": 20, "probes": len(e.vectors.centroids)} | kw))
    return e.search(r, CALLER)


def _scores(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("citation_id", *[F.round(c, 6).alias(c) for c in ("score", "bm25", "vector")], *extra)


@query(_fusion_sql("rrf"))
def fusion_rrf(spark, sf_dir):
    return _scores(_hybrid(spark, sf_dir))


@query(_fusion_sql("mix"))
def fusion_normalized(spark, sf_dir):
    return _scores(_hybrid(spark, sf_dir, fusion="normalized", ratio=0.3))


@query(_fusion_sql("mix"))
def fusion_weighted(spark, sf_dir):
    return _scores(_hybrid(spark, sf_dir, fusion="weighted", ratio=0.3))


@query(bm25_sql(_TWO, SEE) + f", {_KW} SELECT citation_id, round(1e0 / (6e1 + r), 6) AS score, round(bm25, 6) AS bm25, NULL::DOUBLE AS vector FROM k ORDER BY r LIMIT 20")
def search_keyword_mode(spark, sf_dir):
    return _scores(_hybrid(spark, sf_dir, mode="keyword", vector=None))


@query(f"WITH {CHUNKS}, {_VEC} SELECT citation_id, round(1e0 / (6e1 + r), 6) AS score, NULL::DOUBLE AS bm25, round(vector, 6) AS vector FROM n ORDER BY r LIMIT 20")
def search_blank_hybrid(spark, sf_dir):
    """A blank query beside a vector leaves the vector alone."""
    return _scores(_hybrid(spark, sf_dir, query=" "))


@query(
    bm25_sql(_TWO, SEE) + f", {_KW}, f AS (SELECT 'kind' AS facet, kind AS value FROM k UNION ALL SELECT 'modality', modality FROM k UNION ALL SELECT 'doc_id', doc_id FROM k) SELECT facet, value, count(*) AS n FROM f GROUP BY ALL"
)
def facets(spark, sf_dir):
    return engine(spark, sf_dir).facets(SearchRequest(query="the thing", candidates=50, facets=("kind", "modality", "doc_id", "colour")), CALLER)


def _collapse_sql(keys: str, n: int) -> str:
    return _fusion_sql("rrf", f" SELECT citation_id, round(score, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {ORDER}) <= {n} ORDER BY score DESC, {ORDER} LIMIT 20")


@query(_collapse_sql("collection, doc_id", 1))
def collapse_doc(spark, sf_dir):
    return _hybrid(spark, sf_dir, collapse="doc_id").select("citation_id", F.round("score", 6).alias("score"))


@query(_collapse_sql("collection, doc_id, section_id", 2))
def collapse_section(spark, sf_dir):
    return _hybrid(spark, sf_dir, collapse="section_id", max_per_group=2).select("citation_id", F.round("score", 6).alias("score"))


@query(
    _fusion_sql(
        "rrf",
        f", m AS (SELECT *, row_number() OVER w AS r, list_sort(list(chunk_id) OVER (PARTITION BY collection, doc_id, section_id)) AS ids FROM h WINDOW w AS (PARTITION BY collection, doc_id, section_id ORDER BY score DESC, {ORDER})) "
        f"SELECT citation_id, round(score, 6) AS score, CASE WHEN section_id = 0 THEN []::BIGINT[] ELSE list_filter(ids, lambda x: x <> chunk_id) END AS merged_chunk_ids FROM m WHERE section_id = 0 OR r = 1 ORDER BY score DESC, {ORDER} LIMIT 20",
    )
)
def auto_merge(spark, sf_dir):
    return _hybrid(spark, sf_dir, auto_merge=True).select("citation_id", F.round("score", 6).alias("score"), "merged_chunk_ids")


@query(_fusion_sql("rrf", f" SELECT citation_id, round(score, 6) AS score FROM h ORDER BY score DESC, {ORDER} LIMIT 10 OFFSET 10"))
def search_after_page2(spark, sf_dir):
    e = engine(spark, sf_dir)
    r = SearchRequest(query="the thing", vector=query_vector(spark, sf_dir), candidates=50, top_k=10, probes=len(e.vectors.centroids))
    rows = e.search(r, CALLER).collect()
    from dataclasses import replace

    cursor = encode_cursor(rows[-1]["sort_key"], rows[-1]["citation_id"])
    return e.search(replace(r, search_after=cursor), CALLER).select("citation_id", F.round("score", 6).alias("score"))


@query(
    _fusion_sql(
        "rrf",
        f", w AS (SELECT *, list_distinct({_tok('text')}) AS ts FROM h ORDER BY score DESC, {ORDER} LIMIT 15), j AS (SELECT *, len(list_intersect(ts, ['the', 'thing']))::DOUBLE AS c FROM w) "
        f"SELECT citation_id, round(c / (len(ts) + 2 - c), 6) AS rerank FROM j ORDER BY c / (len(ts) + 2 - c) DESC, {ORDER} LIMIT 20",
    )
)
def rerank_jaccard(spark, sf_dir):
    return _hybrid(spark, sf_dir, rerank=15).select("citation_id", F.round("rerank", 6).alias("rerank"))


@query()
def more_like_this(spark, sf_dir):
    return engine(spark, sf_dir).similar("kb:doc1:6", 10, CALLER).select("citation_id", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {CHUNKS} SELECT citation_id, 'doc_render' AS resolve_as, page FROM chunks WHERE {SEE} AND citation_id IN ('kb:doc1:6', 'kb:doc0:0', 'kb:doc0:1', 'aux:doc0:3', 'kb:doc9:999')")
def resolve_citations(spark, sf_dir):
    return engine(spark, sf_dir).resolve(["kb:doc1:6", "kb:doc0:0", "kb:doc0:1", "aux:doc0:3", "kb:doc9:999", "nonsense"], CALLER).select("citation_id", "resolve_as", "page")


@query(f"WITH {CHUNKS} SELECT citation_id, collection, doc_id, chunk_id FROM chunks")
def citation_parse(spark, sf_dir):
    return chunk_view(spark, sf_dir).select(citation_id().alias("citation_id")).withColumn("g", parse_citation(F.col("citation_id"))).select("citation_id", "g.*")


@query(f"WITH {CHUNKS} SELECT modality, kind, count(*) AS n FROM chunks GROUP BY ALL")
def modality_counts(spark, sf_dir):
    return chunk_view(spark, sf_dir).groupBy("modality", "kind").agg(F.count(F.lit(1)).alias("n"))


# evaluation

_JUDGE = """judge AS (SELECT d.lang AS query_id, d.doc_id AS id, greatest(l.quality * 2 - l.toxic, 0)::DOUBLE AS grade FROM documents d JOIN labels l USING (doc_id)),
res AS (SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100)"""
_EVAL = f"""WITH {_JUDGE}, i AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN (pow(2e0, grade) - 1) / log2(r + 1e0) ELSE 0 END) AS idcg, count(*) FILTER (grade > 0) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id::VARCHAR) AS r FROM judge) GROUP BY query_id),
f AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2e0, grade) - 1) / log2(rank + 1e0) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 10) AS hits, min(rank) AS first FROM res JOIN judge USING (query_id, id) WHERE grade > 0 GROUP BY query_id),
m AS (SELECT query_id, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg, CASE WHEN relevant > 0 THEN coalesce(hits, 0) / relevant::DOUBLE ELSE 0 END AS recall, coalesce(hits, 0) / 1e1 AS precision, coalesce(1e0 / first, 0) AS mrr FROM i LEFT JOIN f USING (query_id))"""


def _evaluated(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judge = d.join(labels, "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("citation"), F.greatest(F.col("quality") * 2 - F.col("toxic"), F.lit(0)).cast("double").alias("grade"))
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    results = d.withColumn("rank", F.row_number().over(w)).where("rank <= 100").select(F.col("lang").alias("query_id"), F.col("doc_id").cast("string").alias("citation"), "rank")
    return evaluation.evaluate(results, judge, 10)


@query(_EVAL + " SELECT query_id, round(ndcg, 6) AS ndcg FROM m")
def eval_ndcg(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(_EVAL + " SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision FROM m")
def eval_means(spark, sf_dir):
    return evaluation.mean_metrics(_evaluated(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in evaluation.METRICS])


# reads and writes

_SOME = [("kb", "doc1", 5), ("kb", "doc0", 99), ("aux", "doc0", 3), ("kb", "doc1", 6), ("kb", "doc1", 5)]
_IDS = "ids(collection, doc_id, chunk_id, ordinal) AS (VALUES " + ", ".join(f"('{c}', '{d}', {i}, {o})" for o, (c, d, i) in enumerate(_SOME)) + ")"


@query(f"WITH {CHUNKS}, {_IDS} SELECT ordinal, c.chunk_id IS NOT NULL AS found, c.page FROM ids LEFT JOIN (SELECT * FROM chunks WHERE {SEE}) c USING (collection, doc_id, chunk_id)")
def batch_get_ordered(spark, sf_dir):
    return changes.batch_get(chunk_view(spark, sf_dir), changes.ids_frame(spark, _SOME), visible("acme", ("team-a",))).select("ordinal", "found", "page")


@query(f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN count(*) OVER () > 2 THEN nth_value(chunk_id, 2) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_after FROM chunks WHERE collection = 'kb' AND doc_id = 'doc2' AND chunk_id > 10 ORDER BY chunk_id LIMIT 2")
def keyset_page(spark, sf_dir):
    return changes.page_of(chunk_view(spark, sf_dir), "kb", "doc2", 10, 2).select("chunk_id", "next_after")


@query(f"WITH {CHUNKS}, new AS (SELECT collection, doc_id, chunk_id + 1000000 AS chunk_id, upper(kind) AS kind FROM chunks WHERE page = 7) SELECT collection, doc_id, chunk_id, kind FROM chunks c WHERE NOT EXISTS (FROM new n WHERE n.collection = c.collection AND n.doc_id = c.doc_id) UNION ALL FROM new")
def doc_replace(spark, sf_dir):
    chunks = chunk_view(spark, sf_dir).select(*GID, "kind", "page")
    new = chunks.where("page = 7").withColumns({"chunk_id": F.col("chunk_id") + 1000000, "kind": F.upper("kind")})
    return changes.replace_docs(chunks, new).select(*GID, "kind")


@query(f"WITH {CHUNKS} SELECT collection, doc_id, chunk_id, tenant, CASE WHEN page = 7 THEN 'new' ELSE kind END AS kind, CASE WHEN page = 7 THEN NULL ELSE v END IS NOT NULL AS has_vector FROM chunks")
def chunk_upsert(spark, sf_dir):
    chunks = chunk_view(spark, sf_dir, True).select(*GID, "tenant", "kind", "page", "embedding")
    out = changes.upsert(chunks, chunks.where("page = 7").withColumn("kind", F.lit("new")))
    return out.select(*GID, "tenant", "kind", F.col("embedding").isNotNull().alias("has_vector"))


@query(f"WITH {CHUNKS}, {_IDS} SELECT ordinal, c.chunk_id IS NOT NULL AS deleted FROM ids LEFT JOIN (SELECT * FROM chunks WHERE {SEE}) c USING (collection, doc_id, chunk_id)")
def delete_visible(spark, sf_dir):
    return changes.delete_chunks(chunk_view(spark, sf_dir), changes.ids_frame(spark, _SOME), visible("acme", ("team-a",)))[1]


@query(f"WITH {CHUNKS} SELECT collection, tenant, count(*) AS n FROM chunks WHERE NOT (collection = 'aux' AND tenant = 'acme') OR tenant IS NULL GROUP BY ALL")
def collection_delete(spark, sf_dir):
    return changes.delete_collection(chunk_view(spark, sf_dir), "aux", "acme")[0].groupBy("collection", "tenant").agg(F.count(F.lit(1)).alias("n"))


@query()
def chunk_markdown(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("# "), F.col("role"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("text"))
    return ingest.chunk_texts(docs)


@query()
def chunk_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return ingest.chunk_texts(pages, "html", "page_id", "html")


# addresses and bytes

@query("SELECT doc_id, url_encode(text) AS coded, base64(encode(text)) AS base64, sha256(text) AS digest FROM documents")
def encoded_texts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", M.percent_encode(t).alias("coded"), F.replace(F.base64(F.encode(t, "UTF-8")), F.lit("\r\n"), F.lit("")).alias("base64"), F.sha2(t, 256).alias("digest"))


@query("SELECT page_id, strlen(html)::BIGINT AS n_bytes, sha256(html) AS digest FROM pages")
def data_url_bytes(spark, sf_dir):
    """Pages as data URLs, and back."""
    urls = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("data:text/html;base64,"), F.base64(F.encode("html", "UTF-8"))).alias("url"))
    data = M.data_bytes(F.col("url"))
    return urls.select("page_id", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("digest"))


@query("SELECT p_partkey, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z_][A-Za-z0-9_]{0,62}$') AS joined, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]{0,62}$') AS plain FROM part")
def identifiers(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", M.is_identifier(F.replace(n, F.lit(" "), F.lit("_"))).alias("joined"), M.is_identifier(n).alias("plain"))


@query("SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: least(greatest(round((x + 1e0) * 1.275e2), 0e0), 2.55e2)::INT) AS codes FROM embeddings")
def vector_codes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", M.codes_u8(F.col("embedding")).alias("codes"))


@query("SELECT page_id, 206 AS status, least(strlen(html), 100) - 10 AS size, substr(html, 11, 90) AS body FROM pages WHERE strlen(html) > 10 AND strlen(html) = length(html) UNION ALL SELECT page_id, 416, NULL, NULL FROM pages WHERE strlen(html) <= 10 AND strlen(html) = length(html)")
def byte_ranges(spark, sf_dir):
    """Bytes 10 to 99 of every ASCII page."""
    pages = table(spark, sf_dir, "pages").where(F.octet_length("html") == F.length("html"))
    return pages.select("page_id", M.byte_range(F.encode("html", "UTF-8"), F.lit("bytes=10-99")).alias("r")).select("page_id", "r.status", (F.col("r.stop") - F.col("r.start") + 1).alias("size"), F.decode("r.body", "UTF-8").alias("body"))


@query(
    """WITH u AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 's3://media/acme/' || source WHEN 1 THEN 'local://media/globex/' || source WHEN 2 THEN 's3://other/acme/x' WHEN 3 THEN 's3://media/acme/../x' ELSE 'ftp://media/acme/x' END AS uri FROM documents)
SELECT doc_id, doc_id % 5 <= 2 AS valid, doc_id % 5 = 0 AS allowed FROM u"""
)
def object_uris(spark, sf_dir):
    i = F.col("doc_id") % 5
    uri = F.when(i == 0, F.concat(F.lit("s3://media/acme/"), "source")).when(i == 1, F.concat(F.lit("local://media/globex/"), "source")).when(i == 2, "s3://other/acme/x").when(i == 3, "s3://media/acme/../x").otherwise("ftp://media/acme/x")
    return table(spark, sf_dir, "documents").select("doc_id", uri.alias("uri")).select("doc_id", objects.parse_uri(F.col("uri")).isNotNull().alias("valid"), objects.allowed(F.col("uri"), "media", "acme").alias("allowed"))


@query(f"WITH {CHUNKS} SELECT citation_id, CASE WHEN searchable AND v IS NULL AND trim(text) <> '' THEN 'text' END AS embed_as, CASE WHEN kind = 'image' AND searchable AND v IS NULL THEN CASE WHEN trim(text) <> '' THEN 'text_fallback' ELSE 'missing_bytes' END END AS image_vector_status FROM chunks")
def embed_routing(spark, sf_dir):
    return embedding.route(chunk_view(spark, sf_dir, True), False).select(citation_id().alias("citation_id"), "embed_as", "image_vector_status")


# change streams

_EVENTS = """ev AS (SELECT event_id AS lsn, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'click' THEN 'delete_doc' ELSE 'upsert' END AS op,
  'kb' AS collection, 'doc' || (user_id % 50) AS doc_id, user_id AS chunk_id, event_type AS kind FROM events)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change log: errors delete chunks, clicks documents, all else upserts."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "delete_doc").otherwise("upsert")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("lsn"), F.lit(0).alias("seq"), op.alias("op"), F.lit("kb").alias("collection"), F.concat(F.lit("doc"), F.col("user_id") % 50).alias("doc_id"), F.col("user_id").cast("long").alias("chunk_id"), F.col("event_type").alias("kind"))


@query(
    f"""WITH {CHUNKS}, {_EVENTS}, cut AS (SELECT collection, doc_id, max(lsn) AS cut FROM ev WHERE op = 'delete_doc' GROUP BY ALL),
last AS (SELECT * FROM ev WHERE op <> 'delete_doc' QUALIFY row_number() OVER (PARTITION BY collection, doc_id, chunk_id ORDER BY lsn DESC) = 1)
SELECT collection, doc_id, chunk_id, kind FROM last LEFT JOIN cut USING (collection, doc_id) WHERE op = 'upsert' AND (cut IS NULL OR lsn > cut)
UNION ALL SELECT collection, doc_id, chunk_id, kind FROM chunks c WHERE NOT EXISTS (FROM cut x WHERE x.collection = c.collection AND x.doc_id = c.doc_id)
AND NOT EXISTS (FROM last l WHERE l.collection = c.collection AND l.doc_id = c.doc_id AND l.chunk_id = c.chunk_id)"""
)
def cdc_apply_latest(spark, sf_dir):
    return cdc.apply_changes(chunk_view(spark, sf_dir).select(*GID, "kind"), event_log(spark, sf_dir)).select(*GID, "kind")


@query("SELECT event_type, " + ", ".join(f"sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END)::BIGINT AS le_{b}" for b in service.BOUNDS) + ", count(value) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def latency_histogram(spark, sf_dir):
    return service.latency_histogram(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("total", F.round("total", 2))


@query()
def rate_limit(spark, sf_dir):
    return service.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 5, 0.001)


@query(rf"SELECT page_id, len({_tok('html')}) AS n_tokens FROM pages")
def rerank_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(bigram_tokens(F.col("html"))).alias("n_tokens"))
