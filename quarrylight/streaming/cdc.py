"""Change events folded into the chunk table, in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import GID

DOC = ("collection", "doc_id")
#: lsn, seq (order among equal lsn), op (upsert, delete, delete_doc), gid; the columns of a chunk for upserts.
EVENT_KEYS = ("lsn", "seq", "op")


def survivors(events: DataFrame) -> DataFrame:
    """The last event of each chunk, unless its document was deleted after it."""
    at = F.struct("lsn", "seq")
    cut = events.where("op = 'delete_doc'").groupBy(*DOC).agg(F.max(at).alias("cut"))
    last = events.where("op <> 'delete_doc'").withColumn("n", F.row_number().over(Window.partitionBy(*GID).orderBy(F.desc("lsn"), F.desc("seq")))).where("n = 1").drop("n")
    return last.join(cut, list(DOC), "left").where(F.col("cut").isNull() | (at > F.col("cut"))).drop("cut")


def apply_changes(chunks: DataFrame, events: DataFrame, applied: int | tuple[int, int] = 0) -> DataFrame:
    """The table after all events past ``applied``, an lsn or (lsn, seq).  Applying events twice changes nothing."""
    lsn, seq = applied if isinstance(applied, tuple) else (applied, None)
    past = F.col("lsn") > lsn
    new = events.where(past if seq is None else past | ((F.col("lsn") == lsn) & (F.col("seq") > seq)))
    touched = new.where("op <> 'delete_doc'").select(*GID).distinct()
    docs = new.where("op = 'delete_doc'").select(*DOC).distinct()
    rows = survivors(new).where("op = 'upsert'").drop(*EVENT_KEYS)
    return chunks.join(touched, list(GID), "left_anti").join(docs, list(DOC), "left_anti").unionByName(rows, allowMissingColumns=True)


def refetch(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Events marked incomplete (large values that didn't change aren't sent) with the row from the source; without one they go."""
    whole, part = events.where("not incomplete").drop("incomplete"), events.where("incomplete").select(*EVENT_KEYS, *GID)
    return whole.unionByName(part.join(truth, list(GID)), allowMissingColumns=True)


class Applier:
    """foreachBatch function: applies a batch to a store, then notes how far it came.

    The table and the last (lsn, seq) are written by one manifest, so a crash in
    between leaves the old state, and a batch that comes again is skipped.  The
    events of one lsn may come in several batches, in the order of seq.
    """

    def __init__(self, store):
        self.store = store

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        m = self.store.manifest()
        applied = (m["applied_lsn"], m.get("applied_seq", 1 << 62))  # noted without seq: all of that lsn
        top = batch.agg(F.max(F.struct("lsn", "seq")).alias("top")).first()["top"]
        if top is None or (top["lsn"], top["seq"]) <= applied:
            return
        self.store.write(apply_changes(self.store.read(), batch, applied), applied_lsn=top["lsn"], applied_seq=top["seq"], batch=batch_id)


def run(events: DataFrame, store, checkpoint: str, once: bool = True, every: str = "1 second"):
    """A streaming query from a stream of events into a store."""
    writer = events.writeStream.foreachBatch(Applier(store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
