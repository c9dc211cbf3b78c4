"""Reads and writes of the chunk table as DataFrame functions: a table in, a table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GID

DOC = ("collection", "doc_id")


def ids_frame(spark: SparkSession, ids: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(*g, i) for i, g in enumerate(ids)], "collection string, doc_id string, chunk_id long, ordinal int")


def batch_get(chunks: DataFrame, ids: DataFrame, see: Column | None = None) -> DataFrame:
    """A row for each id, in the order of ordinal; found is false where there is no visible chunk."""
    rows = (chunks if see is None else chunks.where(see)).withColumn("found", F.lit(True))
    return ids.join(rows, list(GID), "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy("ordinal")


def page_of(chunks: DataFrame, collection: str, doc_id: str, after: int | None, limit: int, see: Column | None = None) -> DataFrame:
    """The next chunks of a document; next_after is the last id if more follow, else null."""
    rows = chunks.where((F.col("collection") == collection) & (F.col("doc_id") == doc_id))
    rows = rows if see is None else rows.where(see)
    rows = (rows if after is None else rows.where(F.col("chunk_id") > after)).orderBy("chunk_id").limit(limit + 1)
    numbered = rows.agg(F.array_sort(F.collect_list("chunk_id")).alias("all"))
    mark = numbered.select(F.when(F.size("all") > limit, F.get("all", F.lit(limit - 1))).alias("next_after"), F.get("all", F.lit(limit - 1)).alias("last"))
    return rows.crossJoin(F.broadcast(mark)).where(F.col("last").isNull() | (F.col("chunk_id") <= F.col("last"))).drop("last")


def replace_docs(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` give way to those in it."""
    return chunks.join(new.select(*DOC).distinct(), list(DOC), "left_anti").unionByName(new, allowMissingColumns=True)


def tenant_conflicts(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The ids in ``new`` that belong to another tenant."""
    theirs = new.select(*GID, F.col("tenant").alias("new_tenant"))
    return chunks.select(*GID, "tenant").join(theirs, list(GID)).where(~F.col("tenant").eqNullSafe(F.col("new_tenant"))).select(*GID)


def upsert(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of ``new`` instead of those of the same id; their embeddings are void.  All or nothing: a conflict of tenants raises."""
    if tenant_conflicts(chunks, new).limit(1).count():
        raise ValueError("a chunk belongs to another tenant")
    if "embedding" in chunks.columns:
        new = new.withColumn("embedding", F.lit(None).cast(chunks.schema["embedding"].dataType))
    return chunks.join(new.select(*GID), list(GID), "left_anti").unionByName(new, allowMissingColumns=True)


def delete_chunks(chunks: DataFrame, ids: DataFrame, see: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, (ordinal, deleted) of each id): only chunks the caller sees go."""
    gone = chunks.where(see).join(ids.select(*GID), list(GID), "left_semi").select(*GID)
    told = ids.join(gone.withColumn("deleted", F.lit(True)), list(GID), "left").select("ordinal", F.coalesce("deleted", F.lit(False)).alias("deleted")).orderBy("ordinal")
    return chunks.join(gone, list(GID), "left_anti"), told


def delete_doc(chunks: DataFrame, collection: str, doc_id: str, see: Column) -> DataFrame:
    """Without a document, all chunks of which the caller must see."""
    mine = (F.col("collection") == collection) & (F.col("doc_id") == doc_id)
    if chunks.where(mine & ~see).limit(1).count():
        raise PermissionError("the document has chunks that the caller can't see")
    return chunks.where(~mine)


def object_uris(chunks: DataFrame) -> DataFrame:
    """The stored objects that chunks refer to, thumbnails too."""
    uri = lambda asset: F.when(asset["kind"] == "object", asset["uri"])
    return chunks.select(F.explode(F.array(uri(F.col("media.asset")), uri(F.col("media.thumbnail")))).alias("uri")).where("uri is not null").distinct()


def delete_collection(chunks: DataFrame, collection: str, owner: str | None) -> tuple[DataFrame, DataFrame]:
    """(what stays, ids that went): a collection's chunks of one tenant (None: those without tenant)."""
    mine = (F.col("collection") == collection) & F.col("tenant").eqNullSafe(F.lit(owner))
    return chunks.where(~mine), chunks.where(mine).select(*GID)


def orphaned_uris(old: DataFrame, new: DataFrame) -> DataFrame:
    """Objects that only the old table refers to."""
    return object_uris(old).join(object_uris(new), "uri", "left_anti")


def set_embeddings(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Embeddings from (gid, vector); rows that have the same one already keep their time stamp."""
    bad = vectors.where(~F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if bad.limit(1).count():
        raise ValueError("a vector has a component that isn't finite")
    both = chunks.join(vectors.select(*GID, "vector"), list(GID), "left")
    new = F.col("vector").isNotNull() & ~F.col("embedding").eqNullSafe(F.col("vector").cast("array<float>"))
    out = both.withColumns({"embedding": F.when(new, F.col("vector").cast("array<float>")).otherwise(F.col("embedding")), "embed_model": F.when(new, F.lit(model)).otherwise(F.col("embed_model") if "embed_model" in chunks.columns else F.lit(None))})
    return (out.withColumn("updated_at", F.when(new, F.current_timestamp()).otherwise(F.col("updated_at"))) if "updated_at" in chunks.columns else out).drop("vector")


def ingest_identity(chunks: DataFrame, collection: str, doc_id: str, tenant: str | None, tags: tuple[str, ...]) -> DataFrame:
    """Ids and access from the caller, whatever the input says: its tags, or public without any."""
    return chunks.withColumns({"collection": F.lit(collection), "doc_id": F.lit(doc_id), "tenant": F.lit(tenant).cast("string"), "acl": F.array(*[F.lit(t) for t in tags or ("public",)])})
