"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import fresh, id_range

#: Copies are counted in millionths, as integers: prefix sums are exact in any order of addition.
UNIT = 1_000_000


def offset(source: Column, seed: int) -> Column:
    """The one random offset of a source, in millionths."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source)), 1, 8), 16, 10).cast("long") % UNIT


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows: int = 4096, copy_col: str = "copy"
) -> DataFrame:
    """Documents repeated or left out so that sources get their shares of characters.

    weights gives each source's share (any scale; a source without one gets
    none); without weights a source's share is its characters to the power
    alpha.  All sources together give epochs times the corpus.  Each document
    of a source has the same expected copies; their prefix sum in the order of
    ids, plus one random offset for the source, crosses an integer once for
    each copy that is emitted.  So a source's copies differ from its target by
    less than one document, and a document's from its expectation by less
    than one.

    Returns the columns of docs and ``copy`` (1, 2, ... of a document; it takes
    the place of such a column).  Null and empty sources are one source.  A
    null text counts 0 characters; a source of 0 characters emits nothing.
    Rows without id come first in the order.  Repeated rows are rows of their
    own.  An empty table gives an empty one.

    Plan: counts by (source, id range) -> offsets of the ranges (a small table)
    -> one shuffle of the documents by (source, id range), so that a hot source
    is many tasks' work.
    """
    s, b, n, c, e, start, run, h = fresh(docs, "m_source", "m_range", "m_rows", "m_chars", "m_each", "m_start", "m_run", "m_hash")
    keyed = docs.withColumns({s: F.coalesce(F.col(source_col).cast("string"), F.lit("")), b: id_range(docs, id_col, rows)})
    chars = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    by_range = keyed.groupBy(s, b).agg(F.count(F.lit(1)).alias(n), F.sum(chars).alias(c))
    by_source = by_range.groupBy(s).agg(F.sum(c).alias(c))
    if weights is None:
        wish = F.floor(F.pow(F.col(c).cast("double"), F.lit(float(alpha))))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, round(v * UNIT))]) if weights else None
        wish = (F.coalesce(table[F.col(s)], F.lit(0)) if weights else F.lit(0)).cast("long")
    wish = F.when(F.col(c) > 0, wish).otherwise(0)
    total, wishes = by_source.agg(F.coalesce(F.sum(c), F.lit(0)), F.coalesce(F.sum(wish), F.lit(0))).first()
    each = F.when(F.col(c) > 0, F.round(F.lit(float(UNIT)) * wish.cast("double") / F.lit(float(max(wishes, 1))) * F.lit(float(total) * epochs) / F.col(c).cast("double"))).otherwise(0).cast("long")
    before = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_range.join(by_source.select(s, each.alias(e)), s).select(s, b, e, (F.coalesce(F.sum(n).over(before), F.lit(0)) * F.col(e)).alias(start))
    inside = Window.partitionBy(s, b).orderBy(F.col(id_col).asc_nulls_first(), h).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.col(start) + F.col(run) + offset(F.col(s), seed)
    copies = (F.floor(reach / UNIT) - F.floor((reach - F.col(e)) / UNIT)).cast("int")
    keep = [F.col(x) for x in docs.columns if x.lower() != copy_col.lower()]
    return (
        keyed.withColumn(h, F.xxhash64(F.col(text_col).cast("string")))
        .join(ranges, [s, b])
        .withColumn(run, F.sum(e).over(inside))
        .withColumn(n, copies)
        .where(F.col(n) > 0)
        .select(*keep, F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_col))
    )
